"""Label sets: canonical form, identity, and merging with collector labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scrapelake.functions import messages
from scrapelake.schema import Limits


def sort_labels(labels: Column) -> Column:
    return F.map_from_entries(F.sort_array(F.map_entries(labels)))


def labels_key(labels: Column) -> Column:
    """Compact JSON with sorted keys: the form in which label sets are compared."""
    return F.to_json(sort_labels(labels))


def labels_of(key: Column) -> Column:
    return F.from_json(key, "map<string, string>")


def series_id(metric_name: Column, key: Column) -> Column:
    """Identity of a series, computed where the row is: no lookup, no shuffle."""
    return F.sha2(F.concat_ws("|", metric_name, key), 256)


def label(labels: Column, name: str) -> Column:
    """Label value, the empty string where the label is absent."""
    return F.coalesce(labels[name], F.lit(""))


def without_label(labels: Column, *names: str) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*names))


def _entry_names(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["name"])


def usable_entries(entries: Column) -> Column:
    """Label entries without NULLs; of a repeated name the last one. Maps built from them
    cannot fail, whatever a manifest row holds."""
    names = _entry_names(entries)

    def is_last(entry: Column, i: Column) -> Column:
        later = F.slice(names, i + 2, F.size(names))
        return ~F.array_contains(later, entry["name"])

    whole = F.filter(
        F.filter(entries, is_last), lambda e: e["name"].isNotNull() & e["value"].isNotNull()
    )
    empty = F.array().cast("array<struct<name: string, value: string>>")
    return F.coalesce(whole, empty)


def merge_endpoint_wins(endpoint: Column, collector: Column) -> Column:
    """Endpoint labels stay; collector labels (``array<struct<name, value>>``) fill the gaps."""
    extra = F.filter(collector, lambda e: ~F.map_contains_key(endpoint, e["name"]))
    return F.map_concat(endpoint, F.map_from_entries(extra))


def merge_collector_wins(endpoint: Column, collector: Column) -> Column:
    """Collector labels win; an endpoint label they hide lives on under a free
    ``exported_`` name.

    A name is free if no endpoint or collector label has it and no label hidden earlier took
    it, so the hidden labels are placed in order, by a fold over them alone.
    """
    names = _entry_names(collector)
    hidden = F.filter(collector, lambda e: F.map_contains_key(endpoint, e["name"]))
    kept = F.map_filter(endpoint, lambda k, v: ~F.array_contains(names, k))

    def place(renamed: Column, entry: Column) -> Column:
        name = entry["name"]

        def used(candidate: Column) -> Column:
            return (
                F.map_contains_key(endpoint, candidate)
                | F.array_contains(names, candidate)
                | F.map_contains_key(renamed, candidate)
            )

        def prefixed(times: Column) -> Column:
            return F.concat(F.repeat(F.lit("exported_"), times), name)

        longest = F.size(endpoint) + F.size(names) + F.size(renamed) + 1
        free = F.when(~used(prefixed(F.lit(1))), prefixed(F.lit(1))).otherwise(
            F.try_element_at(
                F.filter(
                    F.transform(F.sequence(F.lit(2), longest), prefixed), lambda c: ~used(c)
                ),
                F.lit(1),
            )
        )
        return F.map_concat(renamed, F.create_map(free, endpoint[name]))

    nothing = F.create_map().cast("map<string, string>")
    own = F.map_from_entries(collector)
    return F.map_concat(kept, F.aggregate(hidden, nothing, place), own)


def force_resolved_ip(labels: Column, resolved_ip: Column) -> Column:
    return F.map_concat(
        without_label(labels, "resolved_ip"),
        F.create_map(F.lit("resolved_ip"), resolved_ip),
    )


def own_labels(collector: Column, resolved_ip: Column) -> Column:
    """Labels a target gives its samples, as a map."""
    others = F.filter(collector, lambda e: e["name"] != "resolved_ip")
    return force_resolved_ip(F.map_from_entries(others), resolved_ip)


def merge_labels(
    endpoint: Column,
    collector: Column,
    honor_labels: Column,
    resolved_ip: Column,
    own: Column | None = None,
) -> Column:
    """Labels of a stored sample.

    Most samples share no label name with their target, and then it does not matter who wins:
    those take a single concatenation. ``own`` may give ``own_labels`` as a column computed
    once per target.
    """
    own = own_labels(collector, resolved_ip) if own is None else own
    merged = F.when(honor_labels, merge_endpoint_wins(endpoint, collector)).otherwise(
        merge_collector_wins(endpoint, collector)
    )
    return F.when(
        F.arrays_overlap(F.map_keys(endpoint), F.map_keys(own)),
        force_resolved_ip(merged, resolved_ip),
    ).otherwise(F.map_concat(endpoint, own))


def instance_label(resolved_ip: Column, port: Column) -> Column:
    host = F.when(
        F.contains(resolved_ip, F.lit(":")), F.concat(F.lit("["), resolved_ip, F.lit("]"))
    ).otherwise(resolved_ip)
    return F.concat(host, F.lit(":"), port.cast("string"))


def _override(base: Column, top: Column) -> Column:
    """Ordered entries: a repeated name keeps its place in ``base`` and takes the new value."""
    replaced = F.transform(
        base,
        lambda b: F.struct(
            b["name"].alias("name"),
            F.coalesce(
                F.try_element_at(F.filter(top, lambda t: t["name"] == b["name"]), F.lit(-1))["value"],
                b["value"],
            ).alias("value"),
        ),
    )
    added = F.filter(top, lambda t: ~F.array_contains(_entry_names(base), t["name"]))
    return F.concat(replaced, added)


def _entry(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), value.alias("value"))


def collector_labels(
    task_labels: Column,
    system: Column,
    module: Column,
    job: Column,
    target_labels: Column,
    resolved_ip: Column,
    port: Column,
) -> Column:
    """Identity labels of one target: task labels, then system, module and job, then target
    labels, each overriding the ones before; ``instance`` only if nobody set it."""
    identity = F.array(
        _entry("system", system), _entry("module", module), _entry("job", job)
    )
    entries = _override(_override(task_labels, identity), target_labels)
    instance = F.array(_entry("instance", instance_label(resolved_ip, port)))
    return F.concat(
        entries, F.filter(instance, lambda e: ~F.array_contains(_entry_names(entries), e["name"]))
    )


def label_fault(labels: Column, limits: Limits, *, merged: bool = False) -> Column:
    """Why a label set breaks the caps, or NULL."""
    kind = "merged label" if merged else "label"

    def oversize(value: Column) -> Column:
        return F.octet_length(value) > limits.label_value_bytes

    first = F.get(F.filter(F.map_entries(labels), lambda e: oversize(e["value"])), 0)["key"]
    return F.when(
        F.size(labels) > limits.labels, messages.label_count(kind, limits.labels)
    ).when(
        F.exists(F.map_values(labels), oversize),
        messages.label_size(kind, limits.label_value_bytes, first),
    )
