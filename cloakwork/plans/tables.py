"""Tables that queries derive from the star schema, as Spark SQL and as DuckDB SQL.

The star schema holds no French personal data, so texts that do are spelt from orders, and entity tables from line items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIRST, LAST = ("Pierre", "Marie", "Jean", "Anne", "Louis"), ("Durand", "Petit", "Martin", "Bernard")
TYPES, METHODS = ("EMAIL", "PHONE", "PERSON", "ORG", "DATE", "IBAN"), ("regex", "spacy", "transformers")
KINDS = ("contrat de bail entre le bailleur", "audience du tribunal", "acte du notaire", "note")


def _pick(words, index: str, duck: bool) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return f"([{listed}])[{index} + 1]" if duck else f"element_at(array({listed}), cast({index} as int) + 1)"


def letters(duck: bool) -> str:
    """doc_id, text, first, last: a French sentence with a person, an address, a day and a number."""
    day = "strftime(o_orderdate, '%d/%m/%Y')" if duck else "date_format(o_orderdate, 'dd/MM/yyyy')"
    pad = "lpad(cast(o_orderkey % 100000000 as varchar), 8, '0')" if duck else "lpad(cast(o_orderkey % 100000000 as string), 8, '0')"
    first, last, kind = _pick(FIRST, "o_custkey % 5", duck), _pick(LAST, "o_orderkey % 4", duck), _pick(KINDS, "o_orderkey % 4", duck)
    return f"""select o_orderkey as doc_id, {first} as first, {last} as last, {kind} as kind, {day} as day, o_custkey as cust,
        concat('M. ', {first}, ' ', {last}, ' a contacte client', o_custkey, '@example.com le ', {day}, ' tel 06', {pad}) as text from orders"""


def keys(duck: bool) -> str:
    """Candidates for numbers with checks; some pass."""
    s = "varchar" if duck else "string"
    pad = lambda e, n: f"lpad(cast({e} as {s}), {n}, '0')"
    return f"""select o_orderkey as id, {pad('o_orderkey * 7919 % 1000000000', 9)} as siren, concat({pad('o_orderkey * 7919 % 1000000000', 9)}, {pad('o_custkey % 100000', 5)}) as siret,
        concat('FR', {pad('o_orderkey % 97', 2)}, {pad('o_orderkey * 31 + o_custkey', 23)}) as iban,
        concat(cast(1 + o_orderkey % 3 as {s}), {pad('o_custkey % 100', 2)}, {pad('1 + o_orderkey % 13', 2)}, {pad('o_orderkey % 96', 2)}, {pad('o_custkey % 1000', 3)}, {pad('o_orderkey % 1000', 3)}, {pad('1 + o_orderkey * 13 % 97', 2)}) as nir,
        concat(case when o_orderkey % 3 = 0 then '+33 ' when o_orderkey % 3 = 1 then '0' else '' end, cast(o_orderkey % 10 as {s}), {pad('o_orderkey % 100000000', 8)}) as phone,
        concat({pad('o_orderkey % 35', 2)}, case when o_custkey % 2 = 0 then '/' else '-' end, 'x') as junk,
        concat({pad('o_orderkey % 35', 2)}, case when o_custkey % 2 = 0 then '/' else '-' end, {pad('o_custkey % 14', 2)}, case when o_custkey % 2 = 0 then '/' else '-' end, cast(1890 + o_orderkey % 230 as {s})) as day,
        concat('u', cast(o_custkey as {s}), case when o_orderkey % 4 = 0 then '@' else '.' end, 'mail', case when o_orderkey % 3 = 0 then '.' else '' end, 'fr') as email from orders"""


def entities(duck: bool) -> str:
    """Entities with the fields that reports and edits use; ids are unique."""
    s = "varchar" if duck else "string"
    kind, method = _pick(TYPES, "l_partkey % 6", duck), _pick(METHODS, "l_suppkey % 3", duck)
    return f"""select l_orderkey as doc_id, concat(cast(l_orderkey as {s}), '-', cast(l_linenumber as {s}), '-', cast(l_partkey as {s}), '-', cast(l_suppkey as {s})) as id, {kind} as type, concat('value', cast(l_partkey % 97 as {s})) as value,
        cast(l_partkey % 200 as int) as start, cast(l_partkey % 200 + 4 + cast(l_quantity as int) % 20 as int) as "end", l_discount * 10 as confidence, concat('[', {kind}, '_', cast(l_suppkey % 20 as {s}), ']') as replacement,
        {method} as method, cast(l_linenumber as int) as total_occurrences from lineitem"""


def groups(duck: bool) -> str:
    """Groups of two references each, one of which may exist nowhere; one group has no name."""
    s = "varchar" if duck else "string"
    refs = f"concat(cast(l_orderkey as {s}), '-', cast(l_linenumber as {s}), '-', cast(l_partkey as {s}), '-', cast(l_suppkey as {s}))"
    listed = f"[{refs}, concat('gone-', cast(l_orderkey % 5 as {s}))]" if duck else f"array({refs}, concat('gone-', cast(l_orderkey % 5 as {s})))"
    return f"select concat('G', cast(l_orderkey as {s}), '-', cast(l_linenumber as {s}), '-', cast(l_partkey as {s}), '-', cast(l_suppkey as {s})) as id, case when l_orderkey % 10 = 3 then '' else 'group' end as name, concat('[EMAIL_', cast(l_suppkey % 20 as {s}), ']') as token, {listed} as entity_ids from lineitem"


SQL = {"letters": letters, "candidates": keys, "entities": entities, "groups": groups}
_READS = {"letters": "orders", "candidates": "orders", "entities": "lineitem", "groups": "lineitem"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    base = spark.read.parquet(f"{sf_dir}/{_READS[name]}.parquet")
    derived = spark.sql(SQL[name](False).replace('"end"', "`end`").replace(f"from {_READS[name]}", "from {base}"), base=base)
    return spread(derived) if name == "letters" else derived


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if it is read in fewer parts: for long work on short rows. A large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def duck(sql: str) -> str:
    """A query with the derived tables that it names put before it."""
    used = [n for n in SQL if f" {n}" in sql]
    ctes = ", ".join(f"{n} as ({SQL[n](True)})" for n in used)
    if not ctes:
        return sql
    return f"with {ctes}, {sql[5:]}" if sql.startswith("with ") else f"with {ctes} {sql}"
