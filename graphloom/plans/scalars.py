"""Plans of scalar functions and small set operations, each over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.links import normal_url
from graphloom.plans.registry import query
from graphloom.sources.tables import Tables, with_derived


def _camel() -> Column:
    return F.concat(F.initcap("event_type"), F.lit("OfUser"))


@query("scl-10", "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '(.)/+$', '\\1') AS u FROM pages")
def endpoint_normaliser(t: Tables) -> DataFrame:
    return t.pages.select("page_id", normal_url(F.concat(F.lit("GET "), F.col("url"))).alias("u"))


@query("scl-11", "SELECT page_id, rtrim(url, '/') AS u FROM pages")
def url_normaliser(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.rtrim("url", F.lit("/")).alias("u"))


@query("scl-12", "SELECT p_partkey, 'a/' || p_name || '/b.py' AS path FROM part")
def path_normaliser(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(".\\a\\"), F.col("p_name"), F.lit("\\b.py"))
    return t.part.select("p_partkey", F.regexp_replace(F.replace(raw, F.lit("\\"), F.lit("/")), r"^(\./)+", "").alias("path"))


@query("scl-13", "SELECT p_partkey, p_brand AS tag, p_name AS rest FROM part")
def tag_split(t: Tables) -> DataFrame:
    both = F.concat_ws("::", "p_brand", "p_name")
    return t.part.select("p_partkey", F.split_part(both, F.lit("::"), F.lit(1)).alias("tag"), F.split_part(both, F.lit("::"), F.lit(2)).alias("rest"))


@query("scl-18", "SELECT page_id, sha256(html) AS h FROM pages")
def file_hash(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.sha2("html", 256).alias("h"))


@query("scl-19", "SELECT doc_id, sha1(text) AS h FROM documents")
def node_hash(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.sha1("text").alias("h"))


@query("scl-22", "SELECT doc_id, CAST(doc_id AS STRING) AS node FROM documents")
def chunk_node(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.substring_index(F.concat_ws("#", F.col("doc_id").cast("string"), F.lit("3")), "#", 1).alias("node"))


@query("scl-24", r"SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), ' OR ') AS q FROM benchmark")
def fts_sanitiser(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.concat_ws(" OR ", F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), 0)).alias("q"))


@query("scl-25", "SELECT event_id, event_id % 3 = 1 AS b FROM events")
def boolean_coercion(t: Tables) -> DataFrame:
    raw = F.element_at(F.array(F.lit("0"), F.lit("True"), F.lit(None).cast("string")), (F.col("event_id") % 3 + 1).cast("int"))
    return t.events.select("event_id", F.coalesce(F.lower(raw).isin("1", "true"), F.lit(False)).alias("b"))


@query("scl-27", "SELECT event_id, CASE WHEN event_id % 8 > 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS at FROM events")
def iso_times(t: Tables) -> DataFrame:
    raw = F.when(F.col("event_id") % 8 == 0, "never").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return t.events.select("event_id", F.unix_seconds(F.try_to_timestamp(raw)).alias("at"))


@query("scl-28", with_derived("SELECT ord, src FROM edges WHERE src IS NOT NULL", "edges"))
def provenance(t: Tables) -> DataFrame:
    meta = F.to_json(F.struct(F.struct("src").alias("prov")))
    return t.edges.select("ord", F.get_json_object(meta, "$.prov.src").alias("src")).where("src IS NOT NULL")


@query("scl-39", "SELECT p_partkey, CASE WHEN length(regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g')) <= 12 THEN regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') END AS domain FROM part")
def domain_normaliser(t: Tables) -> DataFrame:
    d = F.regexp_replace("p_type", "[^A-Za-z0-9]", "")
    return t.part.select("p_partkey", F.when(F.length(d) <= 12, d).alias("domain"))


@query("scl-41", "SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z_$][A-Za-z0-9_$]*'))) AS n FROM documents")
def identifier_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z_$][A-Za-z0-9_$]*"), 0))).alias("n"))


@query("scl-43", "SELECT p_partkey, lower(p_name) AS name FROM part")
def unquote(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('"db".`'), F.col("p_name"), F.lit("`"))
    return t.part.select("p_partkey", F.lower(F.regexp_replace(F.regexp_replace(raw, r'^["`\[]?[^"`\]]*["`\]]?\.', ""), r'["`\[\]]', "")).alias("name"))


@query("scl-44", "SELECT event_id, event_type || '_of_user' AS name FROM events")
def snake_case(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.lower(F.regexp_replace(_camel(), "(?<=[a-z0-9])(?=[A-Z])", "_")).alias("name"))


@query("scl-45", "SELECT event_id, replace(replace(props, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) AS label FROM events")
def label_escape(t: Tables) -> DataFrame:
    out = F.replace(F.replace("props", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return t.events.select("event_id", F.replace(out, F.lit("\n"), F.lit("\\n")).alias("label"))


@query("scl-47", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS rank FROM part")
def role_ranks(t: Tables) -> DataFrame:
    from graphloom.functions.kinds import ROLE_RANKS, lookup

    role = F.element_at(F.array(*map(F.lit, ("controller", "service", "repository", "adapter"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select("p_partkey", lookup(role, ROLE_RANKS, 99).cast("int").alias("rank"))


@query("scl-48", "SELECT page_id, CASE WHEN regexp_full_match(p, '/[A-Za-z].*') THEN p ELSE '' END AS path FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '[=/]+$', '') AS p FROM pages)")
def registry_path(t: Tables) -> DataFrame:
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""), "[=/]+$", "")
    return t.pages.select("page_id", F.when(p.rlike("^/[A-Za-z]"), p).otherwise("").alias("path"))


@query("flt-12", "SELECT p_partkey, nullif(trim(p_name), '') AS name FROM part")
def list_normaliser(t: Tables) -> DataFrame:
    kept = F.filter(F.transform(F.array(F.concat(F.lit(" "), "p_name"), F.lit("  ")), lambda x: F.trim(x)), lambda x: x != "")
    return t.part.select("p_partkey", F.when(F.size(kept) > 0, kept[0]).alias("name"))


@query("flt-13", "SELECT p_partkey, CASE WHEN p_size <= 10 THEN 20 ELSE least(p_size, 40) END AS k FROM part")
def limit_clamp(t: Tables) -> DataFrame:
    asked = F.col("p_size") - 10
    return t.part.select("p_partkey", F.when(asked <= 0, 20).otherwise(F.least(F.col("p_size"), F.lit(40))).alias("k"))


@query("flt-25", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)(^|[^A-Za-z0-9])license([^A-Za-z0-9]|$)')")
def token_match(t: Tables) -> DataFrame:
    return t.documents.where(F.col("text").rlike("(?i)(?<![A-Za-z0-9])license(?![A-Za-z0-9])")).select("doc_id")


@query("set-03", with_derived("SELECT DISTINCT plugin FROM nodes WHERE plugin NOT IN (SELECT plugin FROM edges)", "nodes", "edges"))
def stale_plugins(t: Tables) -> DataFrame:
    return t.nodes.select("plugin").distinct().join(t.edges.select("plugin").distinct(), "plugin", "left_anti")


@query("win-04", "SELECT s_suppkey, s_nationkey, rn FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS rn FROM supplier) WHERE rn <= 60")
def directory_top(t: Tables) -> DataFrame:
    return t.supplier.withColumn("rn", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name"))).where("rn <= 60").select("s_suppkey", "s_nationkey", "rn")


