"""Detection: patterns, checks, dedup by signature, overlap resolution, cleaning, confidence; and merging with a model's spans.

All of it is one projection of the documents: a document's spans stay an array on its row until a report needs rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spans, text, validators
from ..plans import catalogue
from ..plans.settings import Settings

MENTION = "struct<id:string,type:string,value:string,start:int,end:int,confidence:double,replacement:string,context:string,method:string,signature:string>"


def validated_score(kind: Column) -> Column:
    return F.when(kind.isin(*catalogue.VALIDATED), F.lit(1.0)).otherwise(F.lit(0.5))


def confidence(method: Column, validation: Column, agreement: Column, weights: dict | None = None) -> Column:
    """The weighted mean of how sure the method, the checks and other methods are, within 0 and 1."""
    w = weights or Settings().confidence_weights
    total = method * w.get("method", 0) + validation * w.get("validation", 0) + agreement * w.get("agreement", 0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def signature(kind: Column, value: Column) -> Column:
    """What spans of one type must share to be one entity."""
    return F.when(kind == "PERSON", text.person_signature(value)).otherwise(F.trim(F.lower(value)))


def label(kind: Column, labels: dict = catalogue.LABELS) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), kind), F.concat(F.lit("["), kind, F.lit("]")))


def mentions(body: Column, table=catalogue.RUNTIME, width: int = 80) -> Column:
    """Every match that passes its type's check, in the table's order, as array<MENTION>."""

    def of(d: catalogue.Detector) -> Column:
        kind = F.lit(d.type)

        def one(m: Column) -> Column:
            value = F.trim(m["value"])
            return F.struct(
                F.lit("").alias("id"), kind.alias("type"), value.alias("value"), m["start"].alias("start"), m["end"].alias("end"), F.lit(1.0).alias("confidence"),
                label(kind).alias("replacement"), text.context(body, m["start"], m["end"], width).alias("context"), F.lit("regex").alias("method"), signature(kind, value).alias("signature"),
            )

        kept = F.filter(spans.find(body, d.java, d.guard), lambda m: validators.match_ok(m["value"], d.type))
        return F.transform(kept, one).cast(f"array<{MENTION}>")

    found = F.concat(*map(of, table))
    return F.transform(found, lambda m, i: m.withField("id", F.concat(F.lit("regex_"), i.cast("string")))).cast(f"array<{MENTION}>")


def occurrences(body: Column, values: Column) -> Column:
    """At how many places any of the values stands, whatever its case and neighbours."""
    places = F.flatten(F.transform(values, lambda v: F.transform(spans.find_value(body, v), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.size(F.array_distinct(places))


def deduplicated(found: Column, body: Column) -> Column:
    """One entity a signature, in the order first seen: the longest value (the first of equals), all variants and positions."""
    keys = F.array_distinct(F.transform(found, lambda m: F.struct(m["type"].alias("type"), m["signature"].alias("signature"))))

    def group(k: Column) -> Column:
        return F.filter(found, lambda m: (m["type"] == k["type"]) & (m["signature"] == k["signature"]))

    def described(g: Column) -> Column:
        best = F.aggregate(g, F.element_at(g, 1), lambda b, m: F.when(F.length(m["value"]) > F.length(b["value"]), m).otherwise(b))
        return F.struct(g.alias("group"), best.alias("best"), F.array_distinct(F.transform(g, lambda m: m["value"])).alias("variants"))

    def merged(d: Column) -> Column:
        return F.struct(
            *[d["best"][c].alias(c) for c in ("id", "type", "value", "start", "end", "confidence", "replacement", "context", "method", "signature")], d["variants"].alias("variants"), F.transform(d["group"], lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))).alias("all_positions"),
            occurrences(body, d["variants"]).alias("total_occurrences"),
        )

    # Each transform holds what the next one names more than once.
    return F.transform(F.transform(F.transform(keys, group), described), merged)


def cleaned(found: Column) -> Column:
    """Values squeezed and checked once more, dates in their context."""
    tidy = F.transform(found, lambda e: e.withField("value", text.squeezed(e["value"])))
    return F.filter(tidy, lambda e: validators.match_ok_by(e["value"], e["type"]) & ((e["type"] != "DATE") | validators.date_fr(e["value"], e["context"])))


def detect(docs: DataFrame, table=catalogue.RUNTIME, settings: Settings = Settings(), text_col: str = "text", out: str = "entities") -> DataFrame:
    """docs with the array column `out`: entities by position. Steps are columns of their own, so each is computed once."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumn("_mentions", spans.once(mentions(body, table, settings.context)))
    found = found.withColumn("_unique", spans.once(deduplicated(F.col("_mentions"), body)))
    found = found.withColumn("_resolved", spans.once(spans.resolve(F.col("_unique"))))
    scored = F.transform(cleaned(F.col("_resolved")), lambda e: e.withField("confidence", confidence(F.lit(1.0), validated_score(e["type"]), F.lit(0.0), settings.confidence_weights)))
    kept = F.filter(scored, lambda e: e["confidence"] >= settings.min_confidence)
    return found.withColumn(out, spans.once(kept)).drop("_mentions", "_unique", "_resolved")


def all_mentions(docs: DataFrame, table=catalogue.RUNTIME, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a match that passes its check: id, type, value, start, end, confidence, context, before any dedup."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(id_col, spans.once(mentions(body, table)).alias("found"))
    return found.select(id_col, F.inline_outer("found")).where("type is not null").drop("signature")


def raw_spans(docs: DataFrame, table, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Matches alone, without checks: id, type, value, start, end. The text is read once for the whole table."""
    found = [_typed(d, F.col(text_col)) for d in table]
    return docs.select(id_col, spans.once(F.concat(*found)).alias("found")).select(id_col, F.inline_outer("found")).where("type is not null")


def _typed(d: catalogue.Detector, body: Column) -> Column:
    return F.transform(spans.find(body, d.java, d.guard), lambda m: F.struct(F.lit(d.type).alias("type"), m["value"].alias("value"), m["start"].alias("start"), m["end"].alias("end")))


def exploded(detected: DataFrame, id_col: str = "doc_id", column: str = "entities") -> DataFrame:
    """One row an entity."""
    return detected.select(id_col, F.inline_outer(column)).where("type is not null")


# --- Merging with a model's entities: both are array columns of one document ---


def agree(a: Column, b: Column) -> Column:
    """Spans of a with `agreement`: 1 if a span of b overlaps them."""
    return F.transform(a, lambda x: x.withField("agreement", F.when(F.exists(b, lambda y: spans.overlap(x, y)), F.lit(1.0)).otherwise(F.lit(0.0))))


def merge_model(regex: Column, model: Column) -> Column:
    """Pattern spans and the model's: a pattern span of a checked type drives out the first of the model's that it overlaps,
    another gives way to any that it overlaps."""
    start = F.struct(F.filter(regex, lambda x: F.lit(False)).alias("kept"), model.alias("model"))

    def step(s: Column, r: Column) -> Column:
        at = F.array_position(F.transform(s["model"], lambda m: spans.overlap(r, m)), F.lit(True)).cast("int")
        checked = r["type"].isin(*catalogue.VALIDATED)
        kept = F.when((at == 0) | checked, F.array_append(s["kept"], r)).otherwise(s["kept"])
        left = F.when((at > 0) & checked, F.concat(F.slice(s["model"], 1, F.greatest(at - 1, F.lit(0))), F.slice(s["model"], at + 1, F.size(s["model"])))).otherwise(s["model"])
        return F.struct(kept.alias("kept"), left.alias("model"))

    return F.aggregate(regex, start, step, lambda s: F.concat(s["model"], s["kept"]))


def final_confidence(found: Column, weights: dict | None = None) -> Column:
    return F.transform(found, lambda e: e.withField("confidence", confidence(F.when(e["method"] == "regex", F.lit(1.0)).otherwise(e["confidence"]), validated_score(e["type"]), e["agreement"], weights)))


def reanchored(e: Column, body: Column, slack: int = 10) -> Column:
    """The span where its value stands within `slack` characters, or null if it isn't valid."""
    actual = F.substring(body, e["start"] + 1, e["end"] - e["start"])
    first = F.greatest(e["start"] - slack, F.lit(0))
    area = F.substring(body, first + 1, F.least(F.length(body), e["end"] + slack) - first)
    at = F.instr(area, e["value"])
    sound = (e["start"] >= 0) & (e["end"] <= F.length(body)) & (e["start"] < e["end"]) & (F.length(F.trim(e["value"])) >= 2)
    moved = e.withField("start", (first + at - 1).cast("int")).withField("end", (first + at - 1 + F.length(e["value"])).cast("int"))
    return F.when(sound & (F.trim(F.lower(actual)) == F.trim(F.lower(e["value"]))), e).when(sound & (at > 0), moved)


def refined_type(e: Column, body: Column) -> Column:
    """A person whose value holds an organisation's word is one, unless a title stands within 30 characters before."""
    first = F.greatest(e["start"] - 30, F.lit(0))
    before = F.lower(F.substring(body, first + 1, e["start"] - first))
    titled = before.rlike("|".join(catalogue.LONG_TITLES))
    return F.when((e["type"] == "PERSON") & ~titled & F.lower(e["value"]).rlike("|".join(catalogue.ORG_WORDS)), F.lit("ORG")).otherwise(e["type"])


def model_filters(e: Column, body: Column, flags) -> Column:
    """Whether a model's span passes the filters that are on."""
    person = e["type"] == "PERSON"
    minimum = F.when(e["type"].isin("PERSON", "ORG", "LOC"), 2).otherwise(1)
    ok = F.lit(True)
    if flags.get("min_length", True):
        ok = ok & (F.length(e["value"]) >= minimum)
    if flags.get("stopwords", True):
        ok = ok & ~(person & F.lower(e["value"]).isin(*catalogue.STOP_WORDS))
    if flags.get("capitalization", True):
        ok = ok & (~person | F.substring(e["value"], 1, 1).rlike(r"\p{Lu}"))
    if flags.get("title_check", True) and flags.get("require_title", False):
        ok = ok & (~person | F.lower(text.preceding_word(body, e["start"])).isin(*catalogue.CIVIL_TITLES))
    return ok


def post_process(docs: DataFrame, settings: Settings = Settings(), text_col: str = "text", column: str = "entities", width: int = 120) -> DataFrame:
    """A model's spans anchored, cleaned, put in context, refined, filtered and resolved. Needs type, value, start, end, confidence, method, context."""
    body = F.col(text_col)
    anchored = F.filter(F.transform(column, lambda e: reanchored(e, body)), lambda e: e.isNotNull())
    tidy = F.transform(anchored, lambda e: e.withField("value", text.clean_value(e["value"])).withField("context", text.context(body, e["start"], e["end"], width)).withField("type", refined_type(e, body)))
    kept = F.filter(tidy, lambda e: model_filters(e, body, settings.filters))
    return docs.withColumn("_tidy", spans.once(kept)).withColumn(column, spans.once(spans.resolve(F.col("_tidy"), longest_first=False))).drop("_tidy")


def model_confidence(label_: Column, value: Column) -> Column:
    """A stand-in for the confidence of models that give none: by label, length and capital letter, at most 0.98."""
    base = spans.ranked(label_, catalogue.MODEL_TRUST, 0.80)
    length = F.least(F.lit(1.1), 1.0 + (F.length(value) - 3) * 0.02)
    capital = F.when(F.substring(value, 1, 1).rlike(r"\p{Lu}") & label_.isin("PER", "PERSON", "ORG"), 1.05).otherwise(1.0)
    return F.least(F.lit(0.98), base * length * capital)


def renamed(kind: Column, table: dict = catalogue.RENAMED) -> Column:
    """Types by another name; MODEL_LABELS and HARMONISED are such tables too."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), kind), kind)
