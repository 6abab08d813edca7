"""The registered queries of the library's own operators, each beside DuckDB SQL that gives the same rows."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import chunks, similarity, spans, text, validators
from .operators import anonymize, audit, detect, evaluate, legal, manager, ner, search, stats, workflow
from .plans import catalogue
from .plans.settings import Settings
from .plans.tables import duck, spread, table
from .streaming import detect as streaming

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (a loader of tables) under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: table(spark, sf_dir, name))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = duck(sql)
        return f

    return register


def spans_sql(source: str, column: str, pattern: str, kind: str, key: str = "doc_id") -> str:
    """DuckDB: matches and what lies between them, aligned; a match starts after all of both before it."""
    return f"""select {key}, '{kind}' as type, ms[i] as value, cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as integer) as start,
        cast(list_sum(list_transform(gs[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) as integer) as "end"
        from (select {key}, ms, gs, unnest(range(1, len(ms) + 1)) as i from (select {key}, regexp_extract_all({column}, '{pattern}') as ms, regexp_split_to_array({column}, '{pattern}') as gs from {source}) where len(ms) > 0)"""


EMAIL, IP, CARD = ("(?i)" + p for p in (catalogue.EMAIL, catalogue.EXTENDED_PATTERNS["IP_ADDRESS"], catalogue.EXTENDED_PATTERNS["CREDIT_CARD"]))
URL = r"https?://[-\w.]+(?:[:\d]+)?(?:/[\w/_.]*(?:\?[\w&=%.]*)?(?:#\w*)?)?"


# --- detection ---


@query(spans_sql("documents", "text", EMAIL, "EMAIL"))
def detect_email_spans(t):
    return detect.raw_spans(t("documents"), catalogue.detectors("EMAIL"))


@query(spans_sql("documents", "text", IP, "IP_ADDRESS"))
def detect_ip_spans(t):
    return detect.raw_spans(t("documents"), catalogue.detectors("IP_ADDRESS"))


@query(spans_sql("documents", "text", CARD, "CREDIT_CARD"))
def detect_card_spans(t):
    return detect.raw_spans(t("documents"), catalogue.detectors("CREDIT_CARD"))


@query(spans_sql("pages", "url", "(?i)" + URL, "URL", "page_id"))
def detect_url_spans(t):
    return detect.raw_spans(t("pages"), catalogue.detectors("URL"), "page_id", "url")


_FR = """(select doc_id, 'PERSON' as type, concat('M. ', first, ' ', last) as value, text from letters union all select doc_id, 'EMAIL', concat('client', cust, '@example.com'), text from letters
    union all select doc_id, 'DATE', day, text from letters union all select doc_id, 'PHONE', right(text, 10), text from letters)"""


@query(f"""select doc_id, type, value, cast(strpos(text, value) - 1 as integer) as start, cast(strpos(text, value) - 1 + length(value) as integer) as "end", case when type in ('EMAIL', 'PHONE') then 0.8 else 0.65 end as confidence, 'regex' as method,
    case when type = 'PERSON' then '[PERSONNE]' else concat('[', type, ']') end as replacement from {_FR}""")
def detect_entities(t):
    """The whole detection, on French sentences."""
    return detect.exploded(detect.detect(t("letters"))).select("doc_id", "type", "value", "start", "end", F.round("confidence", 6).alias("confidence"), "method", "replacement")


@query(f"select doc_id, type, value, cast((length(lower(text)) - length(replace(lower(text), lower(value), ''))) / length(value) as integer) as n from {_FR}")
def occurrence_counts(t):
    return detect.exploded(detect.detect(t("letters"))).select("doc_id", "type", "value", F.col("total_occurrences").alias("n"))


@query(f"""select doc_id, type, concat(substr(text, greatest(strpos(text, value) - 80, 1), strpos(text, value) - greatest(strpos(text, value) - 80, 1)), '**', value, '**', substr(text, strpos(text, value) + length(value), 80)) as context from {_FR}""")
def context_window(t):
    return detect.all_mentions(t("letters"), catalogue.RUNTIME[:5]).select("doc_id", "type", "context")


@query(f"""select doc_id, type, regexp_extract(rtrim(substr(text, 1, strpos(text, value) - 1)), '(\\w+)$', 1) as word from {_FR} where type <> 'PERSON'""")
def preceding_word(t):
    found = t("letters").select("doc_id", "text", F.inline(F.transform(spans.find(F.col("text"), f"(?U){catalogue.EMAIL}|{catalogue.DATE}|{catalogue.MOBILE}"), lambda m: m)))
    kind = F.when(F.col("value").contains("@"), "EMAIL").when(F.col("value").contains("/"), "DATE").otherwise("PHONE")
    return found.select("doc_id", kind.alias("type"), text.preceding_word(F.col("text"), F.col("start")).alias("word"))


@query(f"select type, count(*) as n from ({' union all '.join(spans_sql('documents', 'text', p, k) for p, k in ((EMAIL, 'EMAIL'), (IP, 'IP_ADDRESS'), (CARD, 'CREDIT_CARD')))}) group by type")
def entity_type_counts(t):
    return stats.count_by(detect.raw_spans(t("documents"), catalogue.detectors("EMAIL", "IP_ADDRESS", "CREDIT_CARD")), "type")


@query(f"""with e as (select distinct on (doc_id, lower(value)) doc_id, lower(value) as signature, value from ({spans_sql('documents', 'text', EMAIL, 'EMAIL')}) order by doc_id, lower(value), length(value) desc, start)
    select doc_id, signature, value from e""")
def dedup_by_signature(t):
    found = detect.detect(t("documents"), catalogue.RUNTIME[:1])
    return detect.exploded(found).select("doc_id", "signature", "value")


@query("select doc_id, concat('[PERSON_1] a contacte [EMAIL_1] le [DATE_1] tel [PHONE_1]') as anonymized from letters")
def anonymize_numbered(t):
    return anonymize.anonymize(detect.detect(t("letters"))).select("doc_id", "anonymized")


@query("select doc_id, concat('[PERSONNE] a contacte [EMAIL] le [DATE] tel [PHONE]') as anonymized from letters")
def anonymize_labels(t):
    return anonymize.anonymize(detect.detect(t("letters")), Settings(token_mode="label")).select("doc_id", "anonymized")


@query("select doc_id, concat('[PERSONNE] a contacte [EMAIL] le [DATE] tel [PHONE]') as anonymized from letters")
def anonymize_positional(t):
    return anonymize.splice_spans(detect.detect(t("letters"))).select("doc_id", "anonymized")


_EMAILS = f"(select doc_id, text, list_distinct(regexp_extract_all(text, '{EMAIL}')) as es from documents)"


@query(f"""with e as (select d.doc_id, d.text, list_transform(range(1, 9), lambda i: s.vs[i]) as vs from documents d left join (select doc_id, list(value order by first, value) as vs from
    (select doc_id, value, min(start) as first from ({spans_sql('documents', 'text', EMAIL, 'EMAIL')}) group by doc_id, value) group by doc_id) s on s.doc_id = d.doc_id),
    r as (select doc_id, {'replace(' * 8}text{''.join(f", coalesce(vs[{k}], chr(1)), '[EMAIL_{k}]')" for k in range(1, 9))} as anonymized from e) select doc_id, anonymized from r""")
def anonymize_emails(t):
    """Documents with their e-mail addresses numbered."""
    return anonymize.anonymize(detect.detect(t("documents"), catalogue.RUNTIME[:1])).select("doc_id", "anonymized")


@query(f"select doc_id, type, value, concat('[', type, '_', dense_rank() over (partition by doc_id, type order by first, value), ']') as token from (select doc_id, type, value, min(start) as first from ({spans_sql('documents', 'text', EMAIL, 'EMAIL')}) group by doc_id, type, value)")
def token_assignment(t):
    return anonymize.numbered_spans(detect.raw_spans(t("documents"), catalogue.detectors("EMAIL"))).select("doc_id", "type", "value", "token")


@query(f"select doc_id, type, concat('[', type, '_1]') as token, case when type = 'PERSON' then lower(substr(value, 4)) else value end as canonical, value as variants from {_FR}")
def token_map(t):
    return anonymize.token_map(anonymize.anonymize(detect.detect(t("letters")))).select("doc_id", "type", "token", "canonical", F.array_join("variants", "|").alias("variants"))


@query("""select doc_id, concat('{"DATE":{"', day, '":{"token":"[DATE_1]","variants":["', day, '"],"canonical":"', day, '"}},"EMAIL":{"', mail, '":{"token":"[EMAIL_1]","variants":["', mail, '"],"canonical":"', mail,
    '"}},"PERSON":{"', lower(name), '":{"token":"[PERSON_1]","variants":["M. ', name, '"],"canonical":"', lower(name), '"}},"PHONE":{"', tel, '":{"token":"[PHONE_1]","variants":["', tel, '"],"canonical":"', tel, '"}}}') as mapping
    from (select doc_id, day, concat('client', cust, '@example.com') as mail, concat(first, ' ', last) as name, right(text, 10) as tel from letters)""")
def mapping_json(t):
    return anonymize.mapping_json(anonymize.anonymize(detect.detect(t("letters"))))


#: Letters some of which hold a value once more within a longer word, where it isn't replaced.
_LEFT = "concat(text, case when doc_id % 3 = 0 then concat(' ref', right(text, 10)) else '' end, case when doc_id % 4 = 1 then concat(' le', day) else '' end)"


@query(rf"""with v as (select doc_id, line, unnest([concat('M. ', first, ' ', last), concat('client', cust, '@example.com'), day, right(text, 10)]) as value from (select *, {_LEFT} as line from letters)),
    judged as (select doc_id, value, contains(regexp_replace(line, concat('\b', replace(value, '.', '\.'), '\b'), '', 'g'), value) as stays from v where regexp_matches(line, concat('\b', replace(value, '.', '\.'), '\b')))
    select doc_id, count_if(stays) = 0 as success, cast(count_if(stays) as int) as not_replaced_count, count_if(not stays) * 100.0::double / count(*) as success_rate, cast(count(*) as int) as entities_replaced from judged group by doc_id""")
def validation_stats(t):
    """Whether every value is gone from the rewritten text; some stay within longer words."""
    done = audit.validation(anonymize.anonymize(detect.detect(t("letters").withColumn("text", F.expr(_LEFT)))))
    return done.select("doc_id", "success", "not_replaced_count", "success_rate", "entities_replaced")


_NAME, _DAY = catalogue.LEAKS["potential_name"], catalogue.LEAKS["date_like"]


@query(f"""select doc_id, len(regexp_extract_all(text, '{catalogue.EMAIL}')) as emails, len(list_filter(regexp_extract_all(text, '{_NAME}'), lambda m: not regexp_matches(m, '(?i)\\b(?:Paris|Lyon|Docteur|Avocat)\\b'))) as names, len(regexp_extract_all(text, '{_DAY}')) as days from letters""")
def leak_scan(t):
    return audit.leaks(t("letters")).select("doc_id", F.col("email_like_count").alias("emails"), F.col("potential_name_count").alias("names"), F.col("date_like_count").alias("days"))


# --- validators and scalar functions ---

_LUHN = "list_sum(list_transform(range(1, length({c}) + 1), lambda i: case when (length({c}) - i) % 2 = 0 then cast(substr({c}, i, 1) as int) when 2 * cast(substr({c}, i, 1) as int) > 9 then 2 * cast(substr({c}, i, 1) as int) - 9 else 2 * cast(substr({c}, i, 1) as int) end)) % 10 = 0"


@query(f"select id, {_LUHN.format(c='siren')} as ok from candidates")
def validate_siren(t):
    return t("candidates").select("id", validators.siren(F.col("siren")).alias("ok"))


@query(f"select id, ({_LUHN.format(c='siret')}) and ({_LUHN.format(c='siren')}) as ok from candidates")
def validate_siret(t):
    return t("candidates").select("id", validators.siret(F.col("siret")).alias("ok"))


@query("select id, cast(concat(substr(iban, 5), '1527', substr(iban, 3, 2)) as hugeint) % 97 = 1 as ok from candidates")
def validate_iban(t):
    return t("candidates").select("id", validators.iban_fr(F.col("iban")).alias("ok"))


@query("select id, regexp_matches(nir, '^[12]\\d{2}(0[1-9]|1[0-2])\\d{10}$') and 97 - cast(substr(nir, 1, 13) as bigint) % 97 = cast(substr(nir, 14, 2) as int) as ok from candidates")
def validate_nir(t):
    return t("candidates").select("id", validators.nir(F.col("nir")).alias("ok"))


@query("select id, regexp_matches(regexp_replace(regexp_replace(phone, '\\D', '', 'g'), '^(0033|33)', '0'), '^0[1-7]\\d{8}$') as ok from candidates")
def validate_phone(t):
    return t("candidates").select("id", validators.phone_fr(F.col("phone")).alias("ok"))


@query("select id, coalesce(year(coalesce(try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%d-%m-%Y'))) between 1900 and 2100, false) as ok from candidates")
def validate_date(t):
    return t("candidates").select("id", validators.date_fr(F.col("day")).alias("ok"))


@query("select id, regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}$') as ok from candidates")
def validate_email(t):
    return t("candidates").select("id", validators.email(F.col("email")).alias("ok"))


_MARKED = "concat(text, case when doc_id % 3 = 0 then chr(1) else '' end, ' «œuvre» “Æ”', case when doc_id % 2 = 0 then chr(9) else chr(31) end, ' l’œil')"


@query(rf"""select doc_id, trim(regexp_replace(translate(replace(replace(replace(replace(regexp_replace({_MARKED}, '[\s\x0B\x1C-\x1F\x85\x{{A0}}]+', ' ', 'g'), 'œ', 'oe'), 'Œ', 'OE'), 'æ', 'ae'), 'Æ', 'AE'), '«»“”‘’', concat(repeat('"', 4), repeat(chr(39), 2))), '[\x00-\x08\x0B-\x1F]', '', 'g')) as clean from documents""")
def preprocess_text(t):
    """Whole documents with marks at their end that are spelt plainly, and controls that go."""
    return t("documents").select("doc_id", text.preprocess(F.expr(_MARKED)).alias("clean"))


@query("select id, regexp_replace(trim(concat(' ', email, '  ', day, '.!; ')), '[.,;:!?]+$', '') as raw, regexp_replace(regexp_replace(trim(concat(' ', email, '  ', day, '.!; ')), '[.,;:!?]+$', ''), '\\s+', ' ', 'g') as clean from candidates")
def clean_value(t):
    v = F.concat(F.lit(" "), F.col("email"), F.lit("  "), F.col("day"), F.lit(".!; "))
    return t("candidates").select("id", F.regexp_replace(F.trim(v), "[.,;:!?]+$", "").alias("raw"), text.clean_value(v).alias("clean"))


@query("""select page_id, regexp_replace(url, '[<>:"/\\\\|?*]', '_', 'g') as name from pages""")
def sanitize_filename(t):
    return t("pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("select doc_id, case when n = 0 then '0 B' when n < 1024 then concat(printf('%.1f', n), ' B') when n < 1048576 then concat(printf('%.1f', n / 1024), ' KB') else concat(printf('%.1f', n / 1048576), ' MB') end as size from (select doc_id, cast(n_chars * 37 as double) as n from documents)")
def format_file_size(t):
    return t("documents").select("doc_id", text.file_size(F.col("n_chars") * 37).alias("size"))


@query("select p_partkey, upper(regexp_replace(regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g'), '^_+|_+$', '', 'g')) as slug from part")
def group_slug(t):
    return t("part").select("p_partkey", text.slug(F.col("p_type")).alias("slug"))


@query("select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat('[', w, ']')), ', ') as listed, array_to_string(string_split(p_name, ' '), '|') as parsed from part")
def variant_lists(t):
    listed = text.in_brackets(F.split("p_name", " "))
    return t("part").select("p_partkey", listed.alias("listed"), F.array_join(text.bracketed(listed), "|").alias("parsed"))


@query("select doc_id, lower(concat(first, ' ', last)) as person_key, lower(concat(first, ' ', last)) as signature, lower(concat('de la ', last)) as last_name, concat(first, ' ', last) as short from letters")
def normalize_names(t):
    name = F.concat(F.lit("M. "), "first", F.lit(" "), "last")
    noble = F.concat(F.lit("Mme "), "first", F.lit(" de La "), "last")
    return t("letters").select("doc_id", text.person_key(name).alias("person_key"), text.person_signature(name).alias("signature"), text.last_name(noble).alias("last_name"), text.short_form(F.concat(F.lit("Monsieur "), "first", F.lit(" "), "last")).alias("short"))


@query("select doc_id, lower(concat(first, ' de la ', last)) as canonical, lower(first) as first_names, lower(last) as last_name, 'de|la' as particles from letters")
def name_parts(t):
    p = text.name_parts(F.concat(F.lit("Mr "), "first", F.lit(" de La "), "last"))
    return t("letters").select("doc_id", p["canonical"].alias("canonical"), F.array_join(p["first_names"], "|").alias("first_names"), p["last_name"].alias("last_name"), F.array_join(p["particles"], "|").alias("particles"))


_SOUND = "regexp_replace(lower(p_name), '[^a-z]', '', 'g')"
for _old, _new in (("ph", "f"), ("th", "t"), ("ch", "x"), ("gn", "n"), ("qu", "k"), ("ck", "k"), ("cq", "k")):
    _SOUND = f"replace({_SOUND}, '{_old}', '{_new}')"


@query(f"select p_partkey, upper(concat(substr({_SOUND}, 1, 1), regexp_replace(substr({_SOUND}, 2), '[aeiouy]', '', 'g'))) as code from part")
def metaphone(t):
    return t("part").select("p_partkey", text.metaphone_fr(F.col("p_name")).alias("code"))


@query("""with p as (select distinct p_name from part) select a.p_name as a, b.p_name as b, levenshtein(a.p_name, b.p_name) as distance from p a, p b where a.p_name <> b.p_name and levenshtein(a.p_name, b.p_name) <= 3""")
def fuzzy_pairs(t):
    return similarity.fuzzy_join(t("part"), t("part"), "p_name", "p_name", 3)


@query("""with p as (select p_partkey, p_name, p_type from part) select p_partkey, round(1 - levenshtein(p_name, p_type)::double / greatest(length(p_name), length(p_type)), 6) as edit,
    round(len(list_intersect(string_split(p_name, ' '), string_split(p_type, ' ')))::double / len(list_distinct(list_concat(string_split(p_name, ' '), string_split(p_type, ' ')))), 6) as jaccard from p""")
def string_similarity(t):
    return t("part").select("p_partkey", F.round(similarity.edit_similarity(F.col("p_name"), F.col("p_type")), 6).alias("edit"), F.round(similarity.jaccard(F.col("p_name"), F.col("p_type")), 6).alias("jaccard"))


@query(f"""with n as (select distinct lower(concat(first, ' ', last, case when cust % 2 = 0 then 'e' else '' end)) as n from letters), c as (select distinct lower(concat(first, ' ', last)) as c from letters),
    scored as (select n, c, case when n = c then 1.0 when n = concat(c, 'e') then 0.5 * 2 * length(c) / (2 * length(c) + 1) + 0.3 / 3 + 0.2 else 0 end as score from n, c)
    select n as name, c as candidate, round(score::double, 6) as score from scored where score >= 0.75 qualify row_number() over (partition by n order by score desc, c) = 1""")
def best_canonical_match(t):
    """Names, half of them with a letter more, against the plain ones: half the indel ratio, a third of the words, the same sound."""
    names = t("letters").select(F.lower(F.concat("first", F.lit(" "), "last", F.when(F.col("cust") % 2 == 0, "e").otherwise(""))).alias("n"), F.lower(F.concat("first", F.lit(" "), "last")).alias("c"))
    return similarity.best_matches(names, names, "n", "c", Settings().weights(), 0.75).withColumn("score", F.round("score", 6))


@query("select id, least(0.98, (case when type in ('PERSON') then 0.92 when type = 'ORG' then 0.88 when type = 'DATE' then 0.9 else 0.8 end) * least(1.1, 1.0 + (length(value) - 3) * 0.02)) as confidence from entities")
def model_confidence(t):
    return t("entities").select("id", detect.model_confidence(F.col("type"), F.col("value")).alias("confidence"))


_KIND = "case cast(right(value, 1) as int) when 0 then 'PER' when 1 then 'PERSON' when 2 then 'ORGANIZATION' when 3 then 'LOC' when 4 then 'MISC' else type end"
_BODY = "concat(case when value like '%7%' then 'monsieur ' when value like '%8%' then 'monsieur ----------------------------- ' else '' end, case when value like '%9%' then 'cabinet ' else '' end, value)"


@query(f"""select id, coalesce(map {{{', '.join(f"'{k}': '{v}'" for k, v in catalogue.RENAMED.items())}}}[kind], kind) as type,
    case when kind = 'PERSON' and value like '%9%' and not contains(substr(body, greatest(start - 30, 0) + 1, start - greatest(start - 30, 0)), 'monsieur') then 'ORG' else kind end as refined
    from (select id, value, {_KIND} as kind, {_BODY} as body, length({_BODY}) - length(value) - case when value like '%9%' then 8 else 0 end as start from entities)""")
def normalize_types(t):
    """Types by their plain names, and persons that are organisations; a title within 30 characters before, not farther, keeps a person."""
    rows = t("entities").select("id", F.expr(_KIND).alias("type"), F.expr(_BODY).alias("body"), F.when(F.col("value").contains("9"), F.concat(F.lit("cabinet "), "value")).otherwise(F.col("value")).alias("value"))
    e = F.struct("type", "value", (F.length("body") - F.length("value")).alias("start"))
    return rows.select("id", detect.renamed(F.col("type")).alias("type"), detect.refined_type(e, F.col("body")).alias("refined"))


# --- filters, searches, orders ---


@query("select id from entities where coalesce(confidence, 1.0) >= 0.5")
def filter_confidence(t):
    return manager.by_confidence(t("entities"), 0.5).select("id")


@query("select id, type from entities where type in ('EMAIL', 'IBAN')")
def filter_types(t):
    return manager.by_type(t("entities"), ["EMAIL", "IBAN"]).select("id", "type")


@query("select id from entities where type in ('EMAIL', 'PERSON') and confidence >= 0.3 and lower(value) like '%value1%' and id in (select unnest(entity_ids) from groups)")
def filter_compound(t):
    return manager.compound(t("entities"), ["EMAIL", "PERSON"], 0.3, "VALUE1", t("groups")).select("id")


@query("select id from entities where lower(value) like '%e7%' or lower(type) like '%e7%' or lower(replacement) like '%e7%'")
def search_entities(t):
    return manager.search(t("entities"), "E7").select("id")


@query("select id, type from entities where type in ('EMAIL', 'PHONE')")
def preset_filter(t):
    return manager.preset(t("entities"), "light").select("id", "type")


@query('select id, value from entities order by value, start, "end", id limit 50 offset 50')
def paginate_entities(t):
    return manager.page(t("entities").select("id", "value", "start", "end"), 2, "value", "start", "end", "id").select("id", "value")


@query("""select type, value, start, "end", count(*) as n from (select distinct type, value, start, "end" from entities) group by all""")
def union_distinct_entities(t):
    e = t("entities")
    return manager.union_distinct(e, e.where("confidence > 0.5")).groupBy("type", "value", "start", "end").agg(F.count("*").alias("n"))


@query("""select doc_id, cast(len(regexp_split_to_array(substr(text, 1, start), '\\n')) as int) as line, value as match, start, "end" from (select s.*, d.text from (SPANS) s join documents d using (doc_id))""".replace("SPANS", spans_sql("documents", "text", r"(?i)\b(?:license|licensed)\b", "x")))
def document_search(t):
    return search.search(t("documents"), r"\b(?:license|licensed)\b", regex=True)


# --- statistics ---


@query("select method, count(*) as n from entities group by method")
def counts_by_method(t):
    return stats.count_by(t("entities"), "method")


@query("select type, count(*) as n, round(count(*) * 100.0 / (select count(*) from entities), 6) as share from entities group by type")
def entity_type_share(t):
    return stats.type_shares(t("entities")).select("type", "n", F.round("share", 6).alias("share"))


_BANDS = "round(min(confidence), 6) as min_confidence, round(max(confidence), 6) as max_confidence, round(avg(confidence), 6) as avg_confidence, round(coalesce(stddev_samp(confidence), 0), 6) as std_confidence, count(*) filter (confidence >= 0.8) as high, count(*) filter (confidence >= 0.5 and confidence < 0.8) as medium, count(*) filter (confidence < 0.5) as low"


def _rounded(df, *keep):
    return df.select(*keep, *[F.round(f"{c}_confidence", 6).alias(f"{c}_confidence") for c in ("min", "max", "avg", "std")], "high", "medium", "low")


@query(f"select {_BANDS} from entities")
def confidence_stats(t):
    return _rounded(stats.confidence_stats(t("entities")))


@query(f"select type, {_BANDS} from entities group by type")
def confidence_by_type(t):
    return _rounded(stats.confidence_stats(t("entities"), "type"), "type")


@query("select cast(least(20, floor(confidence * 20) + 1) as integer) as bin, count(*) as n from entities group by 1")
def confidence_histogram(t):
    return stats.histogram(t("entities"))


@query("""select doc_id, type, n from (select doc_id, type, count(*) as n, row_number() over (partition by doc_id order by count(*) desc, min(start), type) as r from entities group by doc_id, type) where r = 1""")
def most_common_type(t):
    return stats.most_common_type(t("entities"), "doc_id").select("doc_id", "type", "n")


@query("""with p as (select distinct doc_id, unnest(range(start, "end")) as c from entities) select o_orderkey as doc_id, coalesce(n, 0) as covered, round(coalesce(n, 0) * 100.0 / 300, 6) as coverage from orders left join (select doc_id, count(*) as n from p group by doc_id) on doc_id = o_orderkey""")
def text_coverage(t):
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.repeat(F.lit("x"), 300).alias("text"))
    return stats.coverage(t("entities"), docs).select("doc_id", F.col("covered").cast("long").alias("covered"), F.round("coverage", 6).alias("coverage"))


@query("select doc_id, round(coalesce(n, 0) * 1000.0 / n_chars, 6) as density from documents left join (select doc_id, count(*) as n from (SPANS) group by doc_id) using (doc_id)".replace("SPANS", spans_sql("documents", "text", EMAIL, "EMAIL")))
def entity_density(t):
    found = t("documents").select("doc_id", "n_chars", F.size(spans.find(F.col("text"), catalogue.detectors("EMAIL")[0].java, "@")).alias("n"))
    return found.select("doc_id", F.round(stats.density(F.col("n"), F.col("n_chars")), 6).alias("density"))


@query()
def document_report(t):
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.repeat(F.lit("x"), 300).alias("text"))
    return stats.document_report(t("entities"), docs)


@query("""with r as (select doc_id, count(*) filter (confidence < 0.5) as low, bool_or(type in ('EMAIL', 'PHONE', 'IBAN')) as sensitive from entities group by doc_id)
    select doc_id, concat(case when low > 0 then 'low_confidence,' else '' end, case when doc_id % 100 > 50 then 'high_coverage,' when doc_id % 100 < 5 then 'low_coverage,' else '' end, case when sensitive then 'sensitive_data,' else '' end,
        case when low = 0 and not sensitive and doc_id % 100 between 5 and 50 then 'ok,' else '' end) as codes from r""")
def recommendations(t):
    r = t("entities").groupBy("doc_id").agg(F.count_if(F.col("confidence") < 0.5).alias("low"), F.bool_or(F.col("type").isin(*audit.SENSITIVE)).alias("sensitive"))
    codes = audit.recommendations(F.col("low"), (F.col("doc_id") % 100).cast("double"), F.col("sensitive"))
    return r.select("doc_id", F.concat(F.array_join(codes, ","), F.lit(",")).alias("codes"))


@query("""with p as (select 1 + start // 10 as page from entities) select cast((page - 1) // 5 * 5 + 1 as integer) as first_page, concat('Pages ', (page - 1) // 5 * 5 + 1, '-', least((page - 1) // 5 * 5 + 5, (select max(page) from p))) as label, count(*) as n from p group by all""")
def page_distribution(t):
    return stats.page_ranges(t("entities").select((1 + F.floor(F.col("start") / 10)).cast("int").alias("page")))


@query("select type, method, count(*) as n from entities group by rollup(type, method)")
def count_rollup(t):
    return stats.rollup(t("entities")).select("type", "method", "n")


# --- groups ---

_COUNTS = "(select replacement as token, value, cast(sum(greatest(total_occurrences, 1)) as bigint) as n from entities group by replacement, value)"


@query(f"select token, value, n as count from {_COUNTS}")
def group_variants(t):
    return manager.variant_counts(t("entities")).select("token", "value", "count")


@query(f"select regexp_replace(token, '[\\[\\]]', '', 'g') as id, token, regexp_extract(token, '([A-Z]+)', 1) as type, cast(sum(n) as bigint) as total_occurrences, count(*) as variants from {_COUNTS} group by token")
def grouped_entities(t):
    return manager.grouped(t("entities")).select("id", "token", "type", "total_occurrences", F.size("variants").cast("long").alias("variants"))


@query(f"select token, min(value) as value from (select token, value, rank() over (partition by token order by n desc) as r from {_COUNTS}) where r = 1 group by token")
def representative_variant(t):
    return manager.representatives(t("entities"))


@query(f"select count(distinct token) as unique_groups, cast(sum(n) as bigint) as occurrences, round((1 - count(distinct token) / sum(n)) * 100, 6) as reduction from {_COUNTS}")
def reduction_rate(t):
    return manager.group_metrics(manager.grouped(t("entities"))).select("unique_groups", "occurrences", F.round("reduction", 6).alias("reduction"))


@query(f"select token, cast(sum(n) as bigint) as total_occurrences from {_COUNTS} where lower(token) like '%person%' group by token")
def filter_groups(t):
    return manager.filter_groups(manager.grouped(t("entities")), "Person").select("token", "total_occurrences")


@query("select round(avg(len(entity_ids)), 6) as avg_size, max(len(entity_ids)) as max_size, min(len(entity_ids)) as min_size, count(*) filter (len(entity_ids) = 0) as empty from groups")
def group_sizes(t):
    return manager.group_sizes(t("groups")).select(F.round("avg_size", 6).alias("avg_size"), F.col("max_size").cast("long").alias("max_size"), F.col("min_size").cast("long").alias("min_size"), "empty")


@query("select concat('GROUPE_', type) as id, concat('Groupe ', type) as name, count(*) as n from entities group by type having count(*) > 1")
def auto_group(t):
    return manager.auto_groups(t("entities")).select("id", "name", F.size("entity_ids").cast("long").alias("n"))


@query("select p_partkey, case when r = 1 then s else concat(s, '_', r) end as id from (select p_partkey, s, row_number() over (partition by s order by p_partkey) as r from (select p_partkey, upper(regexp_replace(p_type, '[^0-9A-Za-z]+', '_', 'g')) as s from part))")
def unique_group_ids(t):
    return manager.unique_slugs(t("part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "id")


# --- conflicts and integrity ---

_PAIRS = """(select a.doc_id, a.id as id1, b.id as id2, a.confidence as c1, b.confidence as c2, a."end" - a.start as n1, b."end" - b.start as n2, greatest(a.start, b.start) as overlap_start, least(a."end", b."end") as overlap_end
    from entities a join entities b on a.doc_id = b.doc_id and (a.start < b.start or a.start = b.start and a.id < b.id) and b.start < a."end" and a.start < b."end")"""


@query(f"select doc_id, id1, id2, overlap_start, overlap_end, overlap_end - overlap_start as overlap_length from {_PAIRS}")
def overlap_conflicts(t):
    return audit.overlap_conflicts(t("entities")).select("doc_id", "id1", "id2", "overlap_start", "overlap_end", "overlap_length")


@query("select value, string_agg(distinct replacement, '|' order by replacement) as tokens from entities group by value having count(distinct replacement) > 1")
def token_conflicts(t):
    return audit.token_conflicts(t("entities")).select("value", F.array_join("tokens", "|").alias("tokens"))


@query(f"select id from entities where id not in (select case when n1 >= n2 then id2 else id1 end from {_PAIRS})")
def resolve_keep_longest(t):
    return audit.resolve_conflicts(t("entities"), "keep_longest").select("id")


@query(f"select id from entities where id not in (select case when c1 > c2 then id2 when c2 > c1 then id1 when n1 >= n2 then id2 else id1 end from {_PAIRS})")
def resolve_highest_confidence(t):
    return audit.resolve_conflicts(t("entities")).select("id")


@query()
def overlap_resolution(t):
    """The greedy fold, over each document's spans."""
    span = F.struct("id", "type", "method", "confidence", "start", "end")
    rows = t("entities").groupBy("doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return rows.select("doc_id", spans.once(spans.resolve(F.col("spans"))).alias("kept")).select("doc_id", F.inline_outer("kept"))


@query("select g.id as group_id, g.r as entity_id from (select id, unnest(entity_ids) as r from groups) g where g.r not in (select id from entities)")
def orphan_refs(t):
    return audit.dangling(t("groups"), t("entities"))


@query("select id, cast(len(list_filter(entity_ids, lambda r: not starts_with(r, 'gone-'))) as integer) as n from groups")
def orphan_cleanup(t):
    return manager.cleanup(t("groups"), t("entities")).select("id", F.size("entity_ids").alias("n"))


@query("select id, 'start not before end' as error from entities where start >= 30 union all select id, 'confidence out of range' from entities where confidence * 2 > 1")
def validate_entities(t):
    bad = t("entities").withColumn("end", F.when(F.col("start") >= 30, F.col("start")).otherwise(F.col("end"))).withColumn("confidence", F.col("confidence") * 2)
    return audit.entity_errors(bad)


@query("select 'dangling reference' as kind, r as id from (select unnest(entity_ids) as r from groups) where starts_with(r, 'gone-') union all select 'group without name', id from groups where name = '' union all select 'duplicate group', id from groups group by id having count(*) > 1 union all select 'duplicate entity', id from entities group by id having count(*) > 1")
def integrity_report(t):
    return audit.integrity(t("entities"), t("groups"))


# --- edits ---


@query("select id, case when type = 'EMAIL' then 'X' else value end as value, type from entities where type <> 'DATE' union all select concat(id, '+'), value, type from entities where type = 'EMAIL'")
def upsert_import(t):
    e = t("entities").select("id", "value", "type")
    emails = e.where("type = 'EMAIL'")
    new = emails.withColumn("value", F.lit("X")).unionByName(emails.withColumn("id", F.concat("id", F.lit("+"))))
    return manager.upsert(e.where("type <> 'DATE'"), new)


@query("select id, case when replacement = '[EMAIL_1]' then '[EMAIL_2]' else replacement end as replacement from entities")
def merge_groups(t):
    return manager.merge_groups(t("entities"), "[EMAIL_1]", "[EMAIL_2]").select("id", "replacement")


@query("select id, case when replacement in ('[EMAIL_1]', '[EMAIL_2]') then '[CLIENT]' else replacement end as replacement from entities")
def merge_groups_custom(t):
    return manager.merge_policy(t("entities"), "[EMAIL_1]", "[EMAIL_2]", "custom", "[CLIENT]").select("id", "replacement")


@query("select id, case when replacement = '[PHONE_3]' and value = 'value13' then '[PHONE_9]' else replacement end as replacement from entities")
def reassign_variant(t):
    return manager.reassign(t("entities"), "value13", "[PHONE_3]", "[PHONE_9]").select("id", "replacement")


@query("select id from entities where replacement <> '[ORG_5]'")
def delete_by_token(t):
    return manager.delete_by_token(t("entities"), "[ORG_5]").select("id")


@query("select id, start, \"end\" from entities where type <> 'IBAN' union all select concat(id, '-1'), start, start + 2 from entities where type = 'IBAN' union all select concat(id, '-2'), start + 2, \"end\" from entities where type = 'IBAN'")
def split_entity(t):
    e = t("entities")
    ibans = e.where("type = 'IBAN'")
    middle = F.col("start") + 2
    parts = ibans.select("id", "start", middle.alias("end"), "value").unionByName(ibans.select("id", middle.alias("start"), "end", "value"))
    return manager.split(e, parts).select("id", "start", "end")


@query("select id, value from entities")
def undo_edits(t):
    """Every e-mail address is changed and every date deleted, and all of it is undone."""
    e = t("entities").select("id", "type", "value")
    old = F.to_json(F.struct("id", "type", "value"))
    seq = F.row_number().over(_by_id("id")).cast("long")
    events = e.where("type in ('EMAIL', 'DATE')").select(seq.alias("seq"), F.when(F.col("type") == "DATE", "delete_entity").otherwise("update_entity").alias("action"), F.col("id").alias("target_id"), old.alias("old_data"))
    edited = manager.update(e, e.where("type = 'EMAIL'").select("id", F.lit("?").alias("value"))).where("type <> 'DATE'")
    return manager.undo(edited, events, 1).select("id", "value")


def _by_id(c: str):
    from pyspark.sql import Window

    return Window.partitionBy(F.pmod(F.xxhash64(c), F.lit(64))).orderBy(c)


# --- models, templates, evaluation ---

_MODEL = """(select doc_id, id, 'PERSON' as type, start + 3 as start, "end" + 3 as "end" from entities where method = 'spacy')"""


@query(f"""select r.id, case when exists (select 1 from {_MODEL} m where m.doc_id = r.doc_id and m.start < r."end" and r.start < m."end") then 1.0 else 0.0 end as agreement from entities r where r.method = 'regex'""")
def agreement(t):
    e = t("entities")
    span = F.struct("id", "start", "end", F.lit(0.0).alias("agreement"))
    rx = e.where("method = 'regex'").groupBy("doc_id").agg(F.collect_list(span).alias("rx"))
    ai = e.where("method = 'spacy'").withColumn("start", F.col("start") + 3).withColumn("end", F.col("end") + 3).groupBy(F.col("doc_id").alias("d")).agg(F.collect_list(span).alias("ai"))
    both = rx.join(ai, F.col("doc_id") == F.col("d"), "left").withColumn("ai", F.coalesce("ai", F.array().cast("array<struct<id:string,start:int,end:int,agreement:double>>")))
    return both.select(F.inline(detect.agree(F.col("rx"), F.col("ai")))).select("id", "agreement")


@query()
def regex_model_merge(t):
    """Pattern and model spans of each document fused, post-processed and scored."""
    e = t("entities").withColumn("value", F.concat(F.lit("N"), F.substring("value", 2, 9)))
    docs = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.repeat(F.lit("Nalue1 "), 40).alias("text"))
    fused = ner.fuse(e.where("method = 'regex'"), e.where("method <> 'regex'"), docs)
    return fused.select("doc_id", F.inline_outer("entities")).where("type is not null").select("doc_id", "type", "value", "start", "end", F.round("confidence", 6).alias("confidence"), "method")


_SPELT = "case when type = 'PERSON' and method = 'spacy' then 'PERSON_FR' when type = 'PERSON' then 'PERSON_WITH_TITLE' when type = 'ORG' and method <> 'regex' then 'ORG_FR' else type end"


@query("""with r as (select doc_id, id, type, start, "end" from entities where method = 'regex'), m as (select doc_id, concat('m', id) as id, type, start, "end" from entities where method <> 'regex' or doc_id % 2 = 0)
    select doc_id, id, type, start, "end" from r union all select doc_id, id, type, start, "end" from m where not exists (select 1 from r where r.doc_id = m.doc_id and r.start = m.start and r."end" = m."end" and r.type = m.type)""")
def enhanced_merge(t):
    """Pattern and model rows whose types are spelt in the detectors' and the models' own ways; half of the pattern rows are found by the model too."""
    e = t("entities").select("doc_id", "id", F.expr(_SPELT).alias("type"), "start", "end", "method")
    return ner.add_missing(e.where("method = 'regex'").drop("method"), e.where("method <> 'regex' or doc_id % 2 = 0").withColumn("id", F.concat(F.lit("m"), "id")).drop("method"))


@query(f"""select doc_id, type, value, start, "end", least(0.98, {catalogue.MODEL_TRUST['PER']}::double * least(1.1, 1.0::double + (length(value) - 3) * 0.02::double) * 1.05::double) as confidence, 'spacy' as method
    from ({spans_sql('letters', 'text', '[A-Z][a-z]{5,}', 'PERSON')})""")
def model_detection(t):
    """A backend that calls each capital word a person, chunk by chunk."""

    def loader():
        import re

        return lambda body: [("PER", m.start(), m.end(), None) for m in re.finditer(r"\b[A-Z][a-z]{5,}\b", body)]

    return ner.detect_model(t("letters"), ner.CallableBackend(loader))


@query("select doc_id, case when kind like '%bail%' then 'contrat_bail' when kind like '%tribunal%' then 'procedure_civile' when kind like '%notaire%' then 'acte_notarie' end as template, case when doc_id % 7 = 0 then 'acte_notarie' when kind like '%bail%' then 'contrat_bail' when kind like '%tribunal%' then 'procedure_civile' when kind like '%notaire%' then 'acte_notarie' end as chosen from letters")
def template_detect(t):
    kind = F.when(F.col("doc_id") % 7 == 0, "acte_notarie").otherwise("unknown")
    return t("letters").select("doc_id", legal.template_of(F.col("kind")).alias("template"), legal.chosen_template(kind, F.col("kind")).alias("chosen"))


@query("select doc_id, case when kind like '%bail%' then 'contrat_bail' when kind like '%tribunal%' then 'procedure_civile' when kind like '%notaire%' then 'acte_notarie' end as template, concat(kind, ': [PERSON_1] a contacte [EMAIL_1] le [DATE_1] tel [PHONE_1]') as anonymized, true as success from letters")
def legal_pipeline(t):
    docs = t("letters").select("doc_id", F.concat("kind", F.lit(": "), "text").alias("text"))
    return legal.process(docs).select("doc_id", "template", "anonymized", "success")


#: Sentences with labelled tokens, as SQL of both engines: some persons without a title, addresses without a sign, days that no
#: month has, numbers that are no phone's but labelled so, and phone numbers that are labelled as nothing.
_TOKENS = """concat(case when doc_id % 4 = 0 then '' else 'M. ' end, first, ' ', last, ' a contacte ', case when doc_id % 5 = 0 then concat('client', cust, '(at)example.com') else concat('client', cust, '@example.com') end,
    ' le ', case when doc_id % 7 = 0 then '31/02/2020' else day end, ' tel ', case when doc_id % 3 = 0 then '08' else '06' end, right(text, 8), ' ref ', case when doc_id % 6 = 1 then '04' else '09' end, right(text, 8))"""


@query(f"""with tokens as (select doc_id, unnest(string_split(line, ' ')) as token, generate_subscripts(string_split(line, ' '), 1) as place, case when starts_with(line, 'M. ') then 1 else 0 end as titled from (select doc_id, {_TOKENS} as line from letters)),
    marked as (select case when place - titled in (1, 2) then 'PERSON' when place - titled = 5 then 'EMAIL' when place - titled = 7 then 'DATE' when place - titled = 9 then 'PHONE' else 'O' end as label,
        case when titled = 1 and place <= 3 then 'PERSON' when regexp_full_match(token, '[a-z0-9]+@[a-z.]+') then 'EMAIL' when try_strptime(token, '%d/%m/%Y') is not null then 'DATE' when regexp_full_match(token, '0[1-7][0-9]{{8}}') then 'PHONE' else 'O' end as said from tokens),
    figures as (select t.entity, (select count(*) from marked where label = t.entity) as support, (select count(*) from marked where said = t.entity) as found, (select count(*) from marked where label = t.entity and said = t.entity) as hits from (select distinct label as entity from marked where label <> 'O') t)
    select entity, hits::double / found as precision, hits::double / support as recall, 2 * (hits::double / found) * (hits::double / support) / (hits::double / found + hits::double / support) as f1, support from figures""")
def token_label_eval(t):
    """Scores of detection over sentences whose tokens are labelled; no entity's are perfect but by chance."""
    line = F.split(F.expr(_TOKENS), " ")
    titled = F.when(F.get(line, F.lit(0)) == "M.", 1).otherwise(0)
    labels = F.transform(line, lambda w, i: F.when((i - titled).isin(0, 1), "PERSON").when(i - titled == 4, "EMAIL").when(i - titled == 6, "DATE").when(i - titled == 8, "PHONE").otherwise("O"))
    return evaluate.evaluate(t("letters").select(line.alias("tokens"), labels.alias("labels")))


# --- edits of entities and groups, lookups, histories ---


@query("select id from entities where confidence >= 1")
def delete_entities(t):
    e = t("entities")
    return manager.delete(e, e.where("confidence < 1")).select("id")


@query("""with refs as (select id, unnest(entity_ids) as r from groups), kept as (select id, count(distinct r) as n from refs where r not in (select id from entities where confidence < 1) group by id)
    select g.id, cast(coalesce(k.n, 0) as integer) as n from groups g left join kept k on k.id = g.id""")
def forget_entities(t):
    """Groups without the references to deleted entities."""
    return manager.forget(t("groups"), t("entities").where("confidence < 1")).select("id", F.size("entity_ids").alias("n"))


@query("""select id, type, value, start, "end" from entities union all select concat('new-', id), type, value, start, "end" from entities where value <> 'value5' and confidence < 1""")
def add_entities(t):
    """New rows; those that lack a required field are not taken."""
    e = t("entities").select("id", "type", "value", "start", "end")
    new = t("entities").where("confidence < 1").select(F.concat(F.lit("new-"), "id").alias("id"), "type", F.when(F.col("value") != "value5", F.col("value")).alias("value"), "start", "end")
    return manager.add(e, new)


def _first_ids(df: DataFrame, n: int) -> list[str]:
    return [r["id"] for r in df.select("id").orderBy("id").limit(n).collect()]


@query("select id, case when id in (select id from entities order by id limit 3) then '[DOSSIER_A_B]' else replacement end as replacement from entities")
def create_group(t):
    """Entities after a group of three of them was made."""
    ids = _first_ids(t("entities"), 3)
    return manager.create_group(t("groups"), t("entities"), "dossier a-b", ids)[1].select("id", "replacement")


@query("select id, case when replacement = (select token from groups order by id limit 1) then '[NEW_1]' else replacement end as replacement from entities")
def update_group(t):
    """Entities after the token of a group changed."""
    (group,) = _first_ids(t("groups"), 1)
    return manager.update_group(t("groups"), t("entities"), group, "[NEW_1]")[1].select("id", "replacement")


@query("""select id, case when id = (select min(id) from groups) then concat(entity_ids[1], '|', entity_ids[2], '|x|y') when id = (select id from groups order by id limit 1 offset 1) then entity_ids[1] else concat(entity_ids[1], '|', entity_ids[2]) end as members from groups""")
def join_leave_group(t):
    """Two references more in one group, each once; the dangling ones gone from another."""
    g = t("groups")
    first, second = _first_ids(g, 2)
    g = manager.join_group(manager.join_group(g, first, ["x", "y"]), first, ["x"])
    return manager.leave_group(g, second, [f"gone-{k}" for k in range(5)]).select("id", F.array_join("entity_ids", "|").alias("members"))


@query("""select id, case when id = (select min(id) from groups) then 'a|b' when id = (select id from groups order by id limit 1 offset 1) then concat(entity_ids[1], '|', entity_ids[2], '|a') when id = (select id from groups order by id limit 1 offset 2) then entity_ids[1] else concat(entity_ids[1], '|', entity_ids[2]) end as variants from groups""")
def edit_variants(t):
    """One token's variants replaced, another's added to, one of a third excluded."""
    g = t("groups").select(F.col("id").alias("token"), F.col("entity_ids").alias("variants"))
    first, second, third = (r["token"] for r in g.orderBy("token").limit(3).collect())
    g = manager.edit_variants(manager.edit_variants(g, first, [" a", "b", "a "], replace=True), second, ["a", " a "])
    for k in range(5):
        g = manager.exclude_variant(g, third, f"gone-{k}")
    return g.select(F.col("token").alias("id"), F.array_join("variants", "|").alias("variants"))


@query("select id, value from entities order by id limit 1")
def entity_lookup(t):
    (wanted,) = _first_ids(t("entities"), 1)
    return manager.by_id(t("entities"), wanted).select("id", "value")


@query("""select replacement as token, cast(sum(total_occurrences) as bigint) as n from entities where type = 'EMAIL' group by replacement having sum(total_occurrences) > 1""")
def group_view(t):
    """Groups of one type with more than one occurrence."""
    return manager.group_view(manager.grouped(t("entities").where("type = 'EMAIL'").withColumn("all_positions", F.lit(None).cast("array<struct<start:int,end:int>>"))), ["EMAIL"], hide_single=True).select("token", F.col("total_occurrences").cast("long").alias("n"))


_TWICE = "concat(text, ' puis client', cust, '@example.com', case when doc_id % 2 = 0 then '.fr' else '.association.example.org' end)"


@query("select doc_id, 'EMAIL' as type, '[EMAIL_1]' as token, concat('client', cust, '@example.com') as original, concat('client', cust, '@example.com.fr') as variant from letters where doc_id % 2 = 0")
def merge_history(t):
    """Addresses that join an earlier one's token, as they hold it and are much alike; others that hold it are too long."""
    return anonymize.merge_history(anonymize.anonymize(detect.detect(t("letters").withColumn("text", F.expr(_TWICE)))))


_PERSONS = "concat(text, ' avec M. ', last, ', ', case when doc_id % 2 = 0 then 'Mme Julie Lemaitre' else 'personne' end, '.')"


@query(f"""select doc_id, replace(replace(replace(replace(replace(replace(line, concat('M. ', first, ' ', last), mine), concat('M. ', last), mine), 'Mme Julie Lemaitre', hers), concat('client', cust, '@example.com'), '[EMAIL_1]'), day, '[DATE_1]'), tel, '[PHONE_1]') as anonymized
    from (select *, {_PERSONS} as line, right(text, 10) as tel, case when doc_id % 2 = 0 and length(first) + length(last) + 1 < 14 then '[PERSON_2]' else '[PERSON_1]' end as mine, case when length(first) + length(last) + 1 < 14 then '[PERSON_1]' else '[PERSON_2]' end as hers from letters)""")
def anonymize_persons(t):
    """Two persons, one of them named twice; the longest name is numbered first, and a last name alone joins its person."""
    return anonymize.anonymize(detect.detect(t("letters").withColumn("text", F.expr(_PERSONS)))).select("doc_id", "anonymized")


@query("select count(distinct doc_id) as documents, count(*) as entities from entities")
def running_totals(t):
    return stats.running_totals(t("entities").groupBy("doc_id").agg(F.count("*").alias("n")))


@query("select id, type, case when type = 'PERSON' then substr(lower(value), 5) else value end as canonical from (select id, type, concat('Mme ', value) as value from entities)")
def canonical_values(t):
    """Persons by their plain names, other values as they are."""
    return ner.canonical(t("entities").withColumn("value", F.concat(F.lit("Mme "), "value"))).select("id", "type", "canonical")


@query("""select p_partkey, round(2.0::double * least(length(p_name), length(b)) / (length(p_name) + length(b)), 6) as ratio from (select p_partkey, p_name, substr(p_name, 1, 1 + p_partkey % 9) as b from part)""")
def indel_ratio(t):
    """Of a name and its first letters: the shorter one is the longest common subsequence."""
    part = t("part").withColumn("b", F.expr("substr(p_name, 1, cast(1 + p_partkey % 9 as int))"))
    return part.select("p_partkey", F.round(similarity.indel_ratio(F.col("p_name"), F.col("b")), 6).alias("ratio"))


@query()
def process_documents(t):
    """The document entry, with all patterns, over whole documents."""
    done = workflow.process(spread(t("documents")))
    return done.select("doc_id", "status", "success", "entities_replaced", "not_replaced_count", "potential_leaks", "result_hash")


@query(f"""select doc_id, type, value, start, "end" from ({" union all ".join(f"({spans_sql('documents', 'text', d.pattern.replace('*+', '*').replace('++', '+') if d.ignore_case is False else '(?i)' + d.pattern.replace('*+', '*').replace('++', '+'), d.type)})" for d in catalogue.RUNTIME if d.type in ('EMAIL', 'IBAN', 'PHONE', 'SSN', 'SIRET', 'SIREN', 'TVA'))})""")
def detect_document_numbers(t):
    """Addresses and numbers by their patterns alone, over whole documents."""
    return detect.raw_spans(t("documents"), tuple(d for d in catalogue.RUNTIME if d.type in ("EMAIL", "IBAN", "PHONE", "SSN", "SIRET", "SIREN", "TVA"))).select("doc_id", "type", "value", "start", "end")


# --- chunks and streams ---


@query("""select doc_id, cast(s as integer) as "offset", substr(text, s + 1, 1000) as chunk from (select doc_id, text, unnest(range(0, greatest(length(text) - 100 - 1, 0) + 1, 900)) as s from documents)""")
def chunk_strided(t):
    return t("documents").select("doc_id", F.explode(chunks.strided(F.col("text"))).alias("c")).select("doc_id", F.col("c.offset").cast("int").alias("offset"), "c.chunk")


@query("""with recursive c as (
    select doc_id, text, 0 as start, case when 1000 < length(text) and contains(substr(text, 951, 50), ' ') then 1000 - instr(reverse(substr(text, 951, 50)), ' ') else 1000 end as stop from documents where text is not null
    union all select doc_id, text, greatest(stop - 100, start + 1), case when greatest(stop - 100, start + 1) + 1000 < length(text) and contains(substr(text, greatest(stop - 100, start + 1) + 951, 50), ' ')
        then greatest(stop - 100, start + 1) + 1000 - instr(reverse(substr(text, greatest(stop - 100, start + 1) + 951, 50)), ' ') else greatest(stop - 100, start + 1) + 1000 end from c where stop < length(text))
    select doc_id, cast(start as integer) as "offset", substr(text, start + 1, stop - start) as chunk from c""")
def chunk_overlap(t):
    return t("documents").select("doc_id", F.explode(chunks.overlapping(F.col("text"))).alias("c")).select("doc_id", "c.*")


_CUT = """case when length(text) - {at} <= 512 then length(text) when strpos(reverse(substr(text, {at} + 1, 512)), ' .') between 1 and 254 then {at} + 512 - strpos(reverse(substr(text, {at} + 1, 512)), ' .')
    when strpos(reverse(substr(text, {at} + 257, 256)), ' ') > 0 then {at} + 512 - strpos(reverse(substr(text, {at} + 257, 256)), ' ') else {at} + 512 end"""


@query(f"""with recursive c as (select doc_id, text, 0 as start, {_CUT.format(at='0')} as stop from documents where text is not null
    union all select doc_id, text, stop, {_CUT.format(at='stop')} from c where stop < length(text))
    select doc_id, cast(start as integer) as "offset", substr(text, start + 1, stop - start) as chunk from c""")
def chunk_sentence(t):
    return t("documents").select("doc_id", F.explode(chunks.by_sentence(F.col("text"))).alias("c")).select("doc_id", "c.*")


def streaming_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by type over a stream that ends when the folder is read."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    shared = shared or tempfile.gettempdir()
    out = f"{shared}/cloakwork-stream-{os.urandom(8).hex()}"
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # A stream reads a folder, so a single file is named by its folder and a pattern.
    return streaming.counts_now(spark, f"{sf_dir}/documents.parquet*", schema, catalogue.detectors("EMAIL", "IP_ADDRESS", "CREDIT_CARD"), f"{out}/state", f"{out}/counts")


QUERIES["streaming_counts"] = streaming_counts
ORACLE["streaming_counts"] = ORACLE["entity_type_counts"]
