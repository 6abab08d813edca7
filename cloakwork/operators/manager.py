"""Entity and group tables under edit: each operation takes DataFrames and returns new ones; nothing is changed in place.

entities: id, doc_id, type, value, start, end, confidence, replacement, and optionally total_occurrences, all_positions.
groups: id, name, description, type, token, entity_ids.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..plans import catalogue

REQUIRED = ("type", "value", "start", "end")


# --- filters, searches, orders, pages ---


def by_confidence(entities: DataFrame, least: float) -> DataFrame:
    return entities.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= least)


def by_type(entities: DataFrame, types) -> DataFrame:
    return entities.where(F.col("type").isin(*types))


def search(entities: DataFrame, query: str, fields=("value", "type", "replacement")) -> DataFrame:
    """Entities with the query, whatever its case, in any of the fields."""
    return entities.where(reduce(Column.__or__, [F.coalesce(F.lower(F.col(f)).contains(query.lower()), F.lit(False)) for f in fields]))


def compound(entities: DataFrame, types=None, min_confidence=None, query: str | None = None, group: DataFrame | None = None) -> DataFrame:
    """All criteria that are given; group: rows of groups whose entities are meant."""
    out = by_type(entities, types) if types else entities
    out = by_confidence(out, min_confidence) if min_confidence is not None else out
    out = search(out, query, ("value", "type")) if query else out
    return members(out, group) if group is not None else out


def members(entities: DataFrame, groups: DataFrame) -> DataFrame:
    return entities.join(groups.select(F.explode("entity_ids").alias("id")), "id", "left_semi")


def preset(entities: DataFrame, name: str, aliases: bool = False, threshold: bool = False) -> DataFrame:
    """Entities of the preset's types. aliases: also under the names that detectors give; threshold: and as sure as it asks."""
    types, least = catalogue.PRESETS[name]
    types = [*types, *[catalogue.PRESET_ALIASES[t] for t in types if aliases and t in catalogue.PRESET_ALIASES]]
    return by_confidence(by_type(entities, types), least) if threshold else by_type(entities, types)


def ordered(entities: DataFrame, by: str = "start", descending: bool = False) -> DataFrame:
    key = by if by in ("start", "end", "type", "value", "confidence", "created_at") and by in entities.columns else "start"
    ties = [F.col(c) for c in ("start", "end", "id") if c in entities.columns]
    return entities.orderBy(F.desc(key) if descending else F.asc(key), *ties)


def by_id(df: DataFrame, wanted: str) -> DataFrame:
    """The entity or group of this id, as no row or one."""
    return df.where(F.col("id") == wanted).limit(1)


def page(df: DataFrame, number: int, *order, size: int = 50) -> DataFrame:
    """One page of an ordered table; a page before the first is the first, one past the last the last."""
    last = max(1, -(-df.count() // size))
    return df.orderBy(*order).offset((min(max(1, number), last) - 1) * size).limit(size)


def union_distinct(*tables: DataFrame) -> DataFrame:
    """Entities of several tables, one for each (type, value, start, end), from the first table that has it."""
    key = ["type", "value", "start", "end"]
    tagged = reduce(DataFrame.unionByName, [t.withColumn("_from", F.lit(k)) for k, t in enumerate(tables)])
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("_from", "id"))
    return tagged.withColumn("_rank", rank).where("_rank = 1").drop("_from", "_rank")


# --- groups of one token ---


def group_id(token: Column) -> Column:
    return F.regexp_replace(token, r"^[\[\]]+|[\[\]]+$", "")


def variant_counts(entities: DataFrame) -> DataFrame:
    """token, value, type, count, positions of each value that a token stands for."""
    n = F.greatest(F.coalesce(F.col("total_occurrences") if "total_occurrences" in entities.columns else F.lit(1), F.lit(1)), F.lit(1))
    own = F.array(F.struct(F.col("start"), F.col("end")))
    places = F.when(F.size("all_positions") > 0, F.col("all_positions")).otherwise(own) if "all_positions" in entities.columns else own
    rows = entities.where("replacement <> ''").select(F.col("replacement").alias("token"), "value", "type", "id", n.alias("n"), places.alias("places"))
    return rows.groupBy("token", "value").agg(F.min_by("type", "id").alias("type"), F.sum("n").alias("count"), F.array_sort(F.flatten(F.collect_list("places"))).alias("positions"))


def grouped(entities: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """id, token, type, total_occurrences, variants (value, count) of each token; a manual group's type and token override."""
    counts = variant_counts(entities)
    out = counts.groupBy("token").agg(F.min_by("type", "value").alias("type"), F.sum("count").alias("total_occurrences"), F.array_sort(F.collect_list(F.struct("value", "count"))).alias("variants")).withColumn("id", group_id(F.col("token")))
    if manual is None:
        return out.select("id", "token", "type", "total_occurrences", "variants")
    m = manual.where("id is not null").select(F.col("id").alias("m_id"), F.col("token").alias("m_token"), F.col("type").alias("m_type"))
    both = out.join(m, out.id == m.m_id, "full").where("id is not null or m_token is not null")
    return both.select(F.coalesce("id", "m_id").alias("id"), F.coalesce("m_token", "token").alias("token"), F.coalesce("m_type", "type").alias("type"), F.coalesce("total_occurrences", F.lit(0)).alias("total_occurrences"), "variants")


def filter_groups(groups: DataFrame, term: str) -> DataFrame:
    return groups.where(F.lower("token").contains(term.lower()))


def group_view(groups: DataFrame, types=None, hide_single: bool = False) -> DataFrame:
    out = by_type(groups, types) if types else groups
    return (out.where("total_occurrences > 1") if hide_single else out).orderBy(F.desc("total_occurrences"), "token")


def group_metrics(groups: DataFrame) -> DataFrame:
    """unique_groups, occurrences, reduction (per cent of occurrences that grouping saves)."""
    n, total = F.count("*"), F.coalesce(F.sum("total_occurrences"), F.lit(0))
    return groups.agg(n.alias("unique_groups"), total.alias("occurrences"), F.when(total > 0, (1 - n / total) * 100.0).otherwise(F.lit(0.0)).alias("reduction"))


def representatives(entities: DataFrame) -> DataFrame:
    """token, value: each token's most frequent value, the first by text of equals."""
    return variant_counts(entities).groupBy("token").agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("value"))


def group_sizes(groups: DataFrame) -> DataFrame:
    size = F.size(F.coalesce("entity_ids", F.array().cast("array<string>")))
    return groups.agg(F.avg(size).alias("avg_size"), F.max(size).alias("max_size"), F.min(size).alias("min_size"), F.count_if(size == 0).alias("empty"))


def auto_groups(entities: DataFrame) -> DataFrame:
    """A group for each type with more than one entity. The ids of a type are one row's array: meant for a document's or a case's table."""
    found = entities.groupBy("type").agg(F.array_sort(F.collect_list("id")).alias("entity_ids")).where(F.size("entity_ids") > 1)
    name = F.concat(F.lit("Groupe "), F.col("type"))
    return found.select(text.slug(name).alias("id"), name.alias("name"), "type", F.concat(F.lit("["), F.col("type"), F.lit("]")).alias("token"), "entity_ids")


def unique_slugs(groups: DataFrame, name_col: str = "name", *order: str) -> DataFrame:
    """groups with `id`: the name's slug, with _2, _3, ... after the first that has it."""
    n = F.row_number().over(Window.partitionBy("_slug").orderBy(*(order or (name_col,))))
    out = groups.withColumn("_slug", text.slug(F.col(name_col))).withColumn("_n", n)
    return out.withColumn("id", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat("_slug", F.lit("_"), F.col("_n").cast("string")))).drop("_slug", "_n")


# --- edits ---


def add(entities: DataFrame, new: DataFrame) -> DataFrame:
    """New rows that have the required fields, with an id if they lack one."""
    whole = new.where(reduce(Column.__and__, [F.col(c).isNotNull() for c in REQUIRED]))
    named = whole.withColumn("id", F.coalesce("id", F.expr("uuid()"))) if "id" in whole.columns else whole.withColumn("id", F.expr("uuid()"))
    return entities.unionByName(named, allowMissingColumns=True)


def update(entities: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Each row's fields by the change of its key, where that has them."""
    return _merged(entities, changes, key, "left")


def upsert(entities: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """update, and the incoming rows that are new."""
    return _merged(entities, incoming, key, "full")


def _merged(old: DataFrame, new: DataFrame, key: str, how: str) -> DataFrame:
    renamed = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key])
    both = old.join(renamed, F.col(key) == F.col("_key"), how)
    return both.select(*[F.coalesce(key, "_key").alias(key) if c == key else F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns])


def delete(entities: DataFrame, ids: DataFrame) -> DataFrame:
    return entities.join(ids.select("id"), "id", "left_anti")


def delete_by_token(entities: DataFrame, token: str) -> DataFrame:
    return entities.where(F.col("replacement").isNull() | (F.col("replacement") != token))


def forget(groups: DataFrame, ids: DataFrame) -> DataFrame:
    """groups without references to these ids."""
    return _kept_refs(groups, ids, "left_anti")


def cleanup(groups: DataFrame, entities: DataFrame) -> DataFrame:
    """groups without references to entities that don't exist."""
    return _kept_refs(groups, entities, "left_semi")


def _kept_refs(groups: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    refs = groups.select(F.col("id").alias("_group"), F.posexplode("entity_ids").alias("_at", "_ref"))
    kept = refs.join(ids.select(F.col("id").alias("_ref")).distinct(), "_ref", how).groupBy("_group").agg(F.transform(F.array_sort(F.collect_set(F.struct("_at", "_ref"))), lambda s: s["_ref"]).alias("_ids"))
    both = groups.join(kept, F.col("id") == F.col("_group"), "left")
    return both.withColumn("entity_ids", F.coalesce("_ids", F.array().cast("array<string>"))).select(*groups.columns)


def merge_groups(entities: DataFrame, source: str, target: str) -> DataFrame:
    return entities.withColumn("replacement", F.when(F.col("replacement") == source, F.lit(target)).otherwise(F.col("replacement")))


def merge_policy(entities: DataFrame, source: str, target: str, policy: str = "target", custom: str | None = None) -> DataFrame:
    """Two groups under one token: the target's, the source's, or one of its own."""
    token = {"target": target, "source": source, "custom": custom}[policy]
    return merge_groups(merge_groups(entities, source, token), target, token)


def reassign(entities: DataFrame, value: str, source: str, target: str) -> DataFrame:
    return entities.withColumn("replacement", F.when((F.col("value") == value) & (F.col("replacement") == source), F.lit(target)).otherwise(F.col("replacement")))


def split(entities: DataFrame, parts: DataFrame) -> DataFrame:
    """entities, those with parts replaced by them. parts: id, start, end, value; new ids are the old one's with -1, -2, ..."""
    n = F.row_number().over(Window.partitionBy("_id").orderBy("_start", "_end"))
    p = parts.select(F.col("id").alias("_id"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("value").alias("_value")).withColumn("_n", n)
    made = entities.join(p, F.col("id") == F.col("_id")).withColumns({"id": F.concat("id", F.lit("-"), F.col("_n").cast("string")), "start": F.col("_start"), "end": F.col("_end"), "value": F.coalesce("_value", "value")})
    return entities.join(parts.select("id").distinct(), "id", "left_anti").unionByName(made.select(*entities.columns))


def create_group(groups: DataFrame, entities: DataFrame, name: str, ids: list[str], description: str = "", token: str | None = None) -> tuple[DataFrame, DataFrame]:
    """groups with a new one, and entities with its token. A slug that is taken gets a number."""
    spark = groups.sparkSession
    base = spark.range(1).select(F.lit(name).alias("name")).select("name", text.slug(F.col("name")).alias("slug"))
    taken = groups.where(F.col("id").rlike(r"^[0-9A-Z_]+$")).select(F.col("id").alias("taken"))
    used = base.join(taken, (F.col("taken") == F.col("slug")) | F.rlike("taken", F.concat(F.lit("^"), F.col("slug"), F.lit(r"_\d+$"))), "left").groupBy("name", "slug").agg(F.count("taken").alias("n"))
    new = used.select(F.when(F.col("n") == 0, F.col("slug")).otherwise(F.concat("slug", F.lit("_"), (F.col("n") + 1).cast("string"))).alias("id"), "name", F.lit(description).alias("description"), F.array(*map(F.lit, ids)).cast("array<string>").alias("entity_ids"))
    new = new.withColumn("token", F.lit(token) if token else F.concat(F.lit("["), F.col("id"), F.lit("]")))
    marked = entities.join(F.broadcast(new.select(F.col("token").alias("_token"))), how="cross").withColumn("replacement", F.when(F.col("id").isin(*ids), F.col("_token")).otherwise(F.col("replacement"))).drop("_token")
    return groups.unionByName(new, allowMissingColumns=True), marked


def update_group(groups: DataFrame, entities: DataFrame, group: str, token: str) -> tuple[DataFrame, DataFrame]:
    """A group's token changed, with its entities' replacements, and its id if that was the token's."""
    old = groups.where(F.col("id") == group).select(F.col("token").alias("_old"))
    changed = entities.join(F.broadcast(old.limit(1)), F.col("replacement") == F.col("_old"), "left").withColumn("replacement", F.when(F.col("_old").isNotNull(), F.lit(token)).otherwise(F.col("replacement"))).drop("_old")
    same = F.col("id") == group
    out = groups.withColumn("_id", F.when(same & (F.col("id") == group_id(F.col("token"))), group_id(F.lit(token))).otherwise(F.col("id"))).withColumn("token", F.when(same, F.lit(token)).otherwise(F.col("token")))
    return out.withColumn("id", F.col("_id")).drop("_id"), changed


def delete_group(groups: DataFrame, group: str) -> DataFrame:
    return groups.where(F.col("id") != group)


def join_group(groups: DataFrame, group: str, ids: list[str]) -> DataFrame:
    return groups.withColumn("entity_ids", F.when(F.col("id") == group, F.array_union("entity_ids", F.array(*map(F.lit, ids)))).otherwise(F.col("entity_ids")))


def leave_group(groups: DataFrame, group: str, ids: list[str]) -> DataFrame:
    return groups.withColumn("entity_ids", F.when(F.col("id") == group, F.array_except("entity_ids", F.array(*map(F.lit, ids)))).otherwise(F.col("entity_ids")))


def edit_variants(tokens: DataFrame, token: str, values: list[str], replace: bool = False) -> DataFrame:
    """tokens (token, variants) with the values, trimmed and each once, added to a token's variants or in their place."""
    new = F.array_distinct(F.array(*[F.lit(v.strip()) for v in values if v.strip()])) if any(v.strip() for v in values) else F.array().cast("array<string>")
    return tokens.withColumn("variants", F.when(F.col("token") == token, new if replace else F.array_union("variants", new)).otherwise(F.col("variants")))


def exclude_variant(tokens: DataFrame, token: str, value: str) -> DataFrame:
    return tokens.withColumn("variants", F.when(F.col("token") == token, F.array_remove("variants", value)).otherwise(F.col("variants")))


def register_variant(registry: DataFrame, canonical: str, variant: str) -> DataFrame:
    """registry (canonical, variant) with one more form of a name."""
    new = registry.sparkSession.range(1).select(text.name_parts(F.lit(canonical))["canonical"].alias("canonical"), F.lit(variant).alias("variant"))
    return registry.unionByName(new).distinct()


# --- history: an event log, undone by replaying events backwards ---


def log(history: DataFrame, events: DataFrame, most: int = 50) -> DataFrame:
    """history (seq, action, target_id, old_data as JSON) with later events; only the latest `most` are kept."""
    return recent(history.unionByName(events), most)


def recent(history: DataFrame, limit: int = 50) -> DataFrame:
    return history.orderBy(F.desc("seq")).limit(limit)


def cleared(history: DataFrame) -> DataFrame:
    return history.limit(0)


def undo(entities: DataFrame, history: DataFrame, seq: int) -> DataFrame:
    """entities as before the events from seq on: what was added goes, what was changed or deleted comes back as its first old form."""
    later = history.where(F.col("seq") >= seq)
    return _undone(entities, later.where(F.col("action").isin("add_entity", "update_entity", "delete_entity")), "add_entity")


def undo_groups(groups: DataFrame, entities: DataFrame, history: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """groups and entities as before the group events from seq on.

    create_group's old_data holds the members' replacements before it (entities: id, replacement), which they get back. The
    target of add_entity_to_group and remove_entity_from_group is `group:entity`.
    """
    later = history.where(F.col("seq") >= seq)
    back = _undone(groups, later.where(F.col("action").isin("create_group", "update_group", "delete_group")), "create_group")
    moves = later.where(F.col("action").isin("add_entity_to_group", "remove_entity_from_group"))
    first = moves.groupBy("target_id").agg(F.min_by("action", "seq").alias("action")).select(F.split_part("target_id", F.lit(":"), F.lit(1)).alias("of"), F.split_part("target_id", F.lit(":"), F.lit(2)).alias("entity"), "action")
    changed = first.groupBy("of").agg(*[F.collect_list(F.when(F.col("action") == a, F.col("entity"))).alias(c) for a, c in (("add_entity_to_group", "gone"), ("remove_entity_from_group", "again"))])
    ids = F.when(F.col("of").isNull(), F.col("entity_ids")).otherwise(F.array_union(F.array_except("entity_ids", "gone"), "again"))
    back = back.join(changed, F.col("id") == F.col("of"), "left").withColumn("entity_ids", ids).select(*groups.columns)
    made = later.where("action = 'create_group'").select("seq", F.explode(F.from_json("old_data", "entities array<struct<id:string,replacement:string>>")["entities"]).alias("e"))
    old = made.groupBy(F.col("e.id").alias("id")).agg(F.min_by("e.replacement", "seq").alias("before"), F.lit(True).alias("found"))
    restored = entities.join(old, "id", "left").withColumn("replacement", F.when(F.col("found"), F.col("before")).otherwise(F.col("replacement")))
    return back, restored.select(*entities.columns)


def _undone(rows: DataFrame, later: DataFrame, added: str) -> DataFrame:
    first = later.groupBy(F.col("target_id").alias("id")).agg(F.min_by("action", "seq").alias("action"), F.min_by("old_data", "seq").alias("old"))
    back = first.where(F.col("action") != added).select(F.from_json("old", rows.schema).alias("e")).select("e.*")
    return rows.join(first.select("id"), "id", "left_anti").select(*rows.columns).unionByName(back)


class Grouped:
    """The grouped entities of one state of the table, kept until the entities change."""

    def __init__(self):
        self._of, self._kept = None, None

    def get(self, entities: DataFrame, manual: DataFrame | None = None) -> DataFrame:
        if self._kept is None or self._of is not entities:
            self.invalidate()
            self._of, self._kept = entities, grouped(entities, manual).persist()
        return self._kept

    def invalidate(self) -> None:
        if self._kept is not None:
            self._kept.unpersist()
        self._of, self._kept = None, None
