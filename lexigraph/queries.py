"""Named queries over the star-schema and text tables, and their SQL.

The tables hold no source code, so they stand in for it: documents are files,
benchmark passages and conversations are issues, order lines are occurrences of
brand-and-size concepts in the supplier's file, parts are source files of one
form, and suppliers, nations and regions are the graph. Every query runs over
whole tables, except for ``graph_build``, ``localize_issues`` and
``hybrid_ranking``, which are fixed fixtures of five files and three issues.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import words
from .functions.vectors import similar_across, similar_pairs
from .operators import assembly, bm25, concepts, cooccurrence, diffs, evaluation, extraction, graph, models, ranking, reports, retrieval, routing, senses, synonyms
from .plans.build import build
from .plans.localize import hybrid, localize
from .sources.lineage import cut

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ----------------------------------------------------------------- stand-ins


def identifiers(spark, d):
    """Camel and snake case names made of part names: smallRing_economy_get11."""
    p = _t(spark, d, "part")
    name = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit("_"), F.lower("p_type"), F.lit("_get"), F.col("p_size"))
    return p.select("p_partkey", name.alias("ident"))


_IDENT = "SELECT p_partkey, split_part(p_name, ' ', 1) || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || '_' || lower(p_type) || '_get' || p_size AS ident FROM part"
_SPLIT = "flatten(list_transform(list_filter(string_split(ident, '_'), lambda s: length(s) > 0), lambda s: CASE WHEN regexp_matches(s, '[a-z]') THEN list_transform(regexp_extract_all(s, '[A-Z]?[a-z]+'), lambda x: lower(x)) ELSE [lower(s)] END))"


def occurrences(spark, d):
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    rows = li.join(p, li.l_partkey == p.p_partkey)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("occurrence_id"),
        F.concat(F.lit("pkg"), F.col("l_suppkey") % 5, F.lit("/s"), F.col("l_suppkey"), F.lit(".py")).alias("file_path"),
        F.concat(F.lit("f"), F.col("l_orderkey") % 40).alias("function_name"),
        F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit("_"), F.col("p_size")).alias("split_name"),
        F.replace("p_name", F.lit(" "), F.lit("_")).alias("raw_identifier"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"),
        F.concat_ws(" ", "p_type", "p_name").alias("definition"),
    )


_OCC = """occ AS (SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS occurrence_id,
  'pkg' || (l_suppkey % 5) || '/s' || l_suppkey || '.py' AS file_path, 'f' || (l_orderkey % 40) AS function_name,
  replace(lower(p_brand), '#', '') || '_' || p_size AS split_name, replace(p_name, ' ', '_') AS raw_identifier,
  l_orderkey * 10 + l_linenumber AS ordinal, p_type || ' ' || p_name AS definition
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def edges(spark, d):
    s, n = _t(spark, d, "supplier"), _t(spark, d, "nation")
    none = F.lit(None).cast("string")
    c = lambda p, x: F.concat(F.lit(p), x)
    a = s.select(c("S", F.col("s_suppkey")).alias("src"), c("N", F.col("s_nationkey")).alias("dst"), F.lit("co-occurrence").alias("type"), (0.4 + (F.col("s_suppkey") % 6) / 10).alias("weight"), none.alias("track"), c("d", F.col("s_suppkey") % 3).alias("subdomain"))
    b = n.select(c("N", F.col("n_nationkey")), c("R", F.col("n_regionkey")), F.lit("synonym"), F.lit(0.9), F.when(F.col("n_nationkey") % 2 == 0, "naming_variant").otherwise("semantic"), none)
    t = s.select(c("S", F.col("s_suppkey")), c("S", F.floor(F.col("s_suppkey") / 3)), F.lit("synonym"), F.lit(0.8), F.lit("naming_variant"), none).where("s_suppkey > 0")
    return a.union(b).union(t)


_EDGES = """edges AS (
  SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst, 'co-occurrence' AS type, 0.4::DOUBLE + (s_suppkey % 6) / 10::DOUBLE AS weight, NULL::VARCHAR AS track, 'd' || (s_suppkey % 3) AS subdomain FROM supplier
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, 'synonym', 0.9::DOUBLE, CASE WHEN n_nationkey % 2 = 0 THEN 'naming_variant' ELSE 'semantic' END, NULL FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'S' || (s_suppkey // 3), 'synonym', 0.8::DOUBLE, 'naming_variant', NULL FROM supplier WHERE s_suppkey > 0),
both_ways AS (SELECT src AS node, dst AS nbr, type, weight, track, subdomain FROM edges UNION ALL SELECT dst, src, type, weight, track, subdomain FROM edges),
adj AS (SELECT DISTINCT node, nbr FROM both_ways)"""


def concept_file(spark, d):
    return _t(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("concept"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("file")).distinct()


_CF = "cf AS (SELECT DISTINCT 'S' || l_suppkey AS concept, 'o' || l_orderkey AS file FROM lineitem)"


def _nodes(spark, d):
    e = edges(spark, d)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def brand_baskets(spark, d):
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(F.col("l_orderkey").alias("context"), F.col("p_brand").alias("concept"), (F.col("l_orderkey") % 7).cast("string").alias("subdomain")).distinct()


_BASKETS = """m AS (SELECT DISTINCT l_orderkey AS context, p_brand AS concept, (l_orderkey % 7)::VARCHAR AS subdomain FROM lineitem JOIN part ON l_partkey = p_partkey),
pair AS (SELECT x.concept AS a, y.concept AS b, x.subdomain, count(*) AS n FROM m x JOIN m y ON x.context = y.context AND x.concept < y.concept GROUP BY ALL),
cnt AS (SELECT a, b, sum(n)::BIGINT AS n, arg_max(subdomain, (n, -ascii(subdomain))) AS dom, max(n) AS top FROM pair GROUP BY a, b HAVING sum(n) >= 3),
big AS (SELECT context FROM m GROUP BY context HAVING count(*) >= 2),
tot AS (SELECT concept, count(*) AS t FROM m SEMI JOIN big USING (context) GROUP BY concept),
j AS (SELECT a, b, n, x.t AS ta, y.t AS tb, dom, top, (SELECT count(DISTINCT context) FROM m)::DOUBLE AS c FROM cnt JOIN tot x ON a = x.concept JOIN tot y ON b = y.concept)"""


def issues(spark, d):
    c = _t(spark, d, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("issue_id"), F.col("text"))


_ISSUES = "issues AS (SELECT conv_id * 1000 + turn AS issue_id, text FROM conversations)"
_TOKENS = f"list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: length(t) >= 2 AND NOT list_contains({_list(words.STOPWORDS)}, t))"

# --------------------------------------------------------------- text functions


@query(f"WITH i AS ({_IDENT}) SELECT p_partkey, ident, array_to_string({_SPLIT}, ',') AS parts FROM i")
def split_identifiers(spark, d):
    return identifiers(spark, d).select("p_partkey", "ident", F.array_join(T.split_identifier(F.col("ident")), ",").alias("parts"))


@query(f"""WITH i AS ({_IDENT}), s AS (SELECT p_partkey, {_SPLIT} AS parts FROM i)
SELECT p_partkey, array_to_string(list_filter(parts, lambda t: length(t) >= 2 AND NOT list_contains({_list(words.blocklist())}, t) AND NOT regexp_full_match(t, '[0-9]+')), '_') AS name FROM s""")
def filter_tokens(spark, d):
    return identifiers(spark, d).select("p_partkey", T.concept_name(F.col("ident")).alias("name"))


@query(f"WITH {_ISSUES}, t AS (SELECT issue_id, {_TOKENS} AS tokens FROM issues) SELECT issue_id, len(tokens)::BIGINT AS n, array_to_string(tokens, ' ') AS tokens FROM t")
def issue_tokens(spark, d):
    return issues(spark, d).select("issue_id", T.issue_tokens(F.col("text")).alias("t")).select("issue_id", F.size("t").cast("bigint").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("""WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)) AS l FROM documents),
x AS (SELECT doc_id, flatten(list_transform(l, lambda t: list_concat([t], CASE WHEN contains(t, '_') THEN list_filter(string_split(t, '_'), lambda p: length(p) >= 2) ELSE [] END))) AS l FROM t)
SELECT doc_id, len(l)::BIGINT AS n, md5(array_to_string(l, ' ')) AS digest FROM x""")
def code_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.code_tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").cast("bigint").alias("n"), F.md5(F.array_join("t", " ")).alias("digest"))


_STEM = "CASE WHEN length(w) <= 3 THEN w " + " ".join(f"WHEN ends_with(w, '{s}') AND length(w) >= {len(s) + 3} THEN w[:length(w) - {len(s)}] || '{i}'" for s, i in T._SUFFIXES) + " ELSE w END"


@query(f"WITH {_ISSUES}, w AS (SELECT DISTINCT unnest({_TOKENS}) AS w FROM issues) SELECT w AS token, {_STEM} AS stem FROM w")
def light_stems(spark, d):
    return issues(spark, d).select(F.explode(T.issue_tokens(F.col("text"))).alias("token")).distinct().select("token", T.light_stem(F.col("token")).alias("stem"))


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) AS path FROM pages)
SELECT page_id, path, regexp_replace(path, '^.*?en/', '') AS below, CASE WHEN split_part(path, '/', 1) = '' THEN '_other' ELSE split_part(path, '/', 1) END AS subdomain,
CASE WHEN split_part(path, '/', 1) IN ('en', 'de') THEN split_part(path, '/', 1) ELSE 'other' END AS known FROM p""")
def path_normaliser(spark, d):
    rows = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/]*/([^?#]*)", 1).alias("path"))
    return rows.select("page_id", "path", T.normal_path(F.col("path"), ["en"]).alias("below"), T.subdomain(F.col("path"), other="_other").alias("subdomain"), T.subdomain(F.col("path"), ["en", "de"]).alias("known"))


@query("""WITH t AS (SELECT conv_id, turn, trim(split_part(text, chr(10), 1)) AS title, CASE WHEN contains(text, chr(10)) THEN trim(text[strpos(text, chr(10)) + 1:]) ELSE '' END AS body FROM conversations),
l AS (SELECT *, len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: length(w) >= 3)) AS n, list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#')) AS lines FROM t)
SELECT conv_id, turn, CASE WHEN n < 5 AND len(lines) > 0 THEN lines[1] || chr(10) || chr(10) || title ELSE title END AS enriched FROM l""")
def short_titles(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", T.first_line(F.col("text")).alias("title"), T.after_first_line(F.col("text")).alias("body"))
    return rows.select("conv_id", "turn", T.enriched_title(F.col("title"), F.col("body")).alias("enriched"))


@query("""WITH a AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Yes, same' ELSE 'No' END || chr(10) || role AS answer FROM conversations)
SELECT conv_id, turn, starts_with(upper(trim(split_part(answer, chr(10), 1))), 'YES') AS yes, trim(split_part(answer, chr(10), 2)) AS reason FROM a""")
def judge_answers(spark, d):
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("turn") % 2 == 0, "Yes, same").otherwise("No"), F.lit("\n"), F.col("role")).alias("a"))
    return rows.select("conv_id", "turn", T.says_yes(F.col("a")).alias("yes"), T.reason_of(F.col("a")).alias("reason"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_extract(spark, d):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return _t(spark, d, "events").select("event_id", F.from_json(T.embedded_json(fenced), "k bigint")["k"].alias("k"))


@query("SELECT p_partkey, md5(p_name || '|' || p_brand) AS key, round_even(p_retailprice / 7, 1) AS price FROM part")
def cache_keys_and_rounding(spark, d):
    return _t(spark, d, "part").select("p_partkey", T.cache_key(F.col("p_name"), F.col("p_brand")).alias("key"), T.half_even(F.col("p_retailprice") / 7, 1).alias("price"))


# --------------------------------------------------------------- concepts


@query(f"WITH {_OCC}, f AS (SELECT split_name, count(DISTINCT file_path) AS n FROM occ GROUP BY 1), t AS (SELECT count(DISTINCT file_path) AS n FROM occ) SELECT o.split_name, count(*) AS n FROM occ o JOIN f USING (split_name), t WHERE f.n <= 0.4 * t.n GROUP BY 1")
def coverage_filter(spark, d):
    return concepts.covered(occurrences(spark, d), ratio=0.4).groupBy("split_name").agg(F.count("*").alias("n"))


@query(f"""WITH i AS (SELECT p_partkey, ident, p_brand AS file_path, p_partkey % 9 = 0 AS imported, lower(ident) AS low FROM ({_IDENT}) JOIN part USING (p_partkey)),
s AS (SELECT file_path, imported, low, {_SPLIT} AS parts FROM i), b AS (SELECT *, list_filter(parts, lambda t: list_contains({_list(words.blocklist())}, t)) AS bad FROM s),
t AS (SELECT file_path, unnest(CASE WHEN imported THEN list_append(parts, low) WHEN len(bad) > 0 THEN list_append(bad, low) ELSE [] END) AS token FROM b)
SELECT token, count(DISTINCT file_path) AS files FROM t WHERE length(token) >= 2 GROUP BY token""")
def soft_index(spark, d):
    rows = identifiers(spark, d).join(_t(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")
    raw = rows.select(F.col("p_brand").alias("file_path"), F.col("ident").alias("raw_identifier"), F.when(F.col("p_partkey") % 9 == 0, "import").otherwise("variable").alias("identifier_type"))
    return concepts.soft_index(raw).groupBy("token").agg(F.count("*").alias("files"))


@query(f"""WITH {_OCC}, r AS (SELECT split_name, raw_identifier, count(*) AS n, min(ordinal) AS o FROM occ GROUP BY ALL)
SELECT split_name AS canonical_name, sum(n)::BIGINT AS frequency, string_agg(raw_identifier, ',' ORDER BY o, raw_identifier) AS raws FROM r GROUP BY 1""")
def concept_aggregate(spark, d):
    return concepts.concepts(occurrences(spark, d)).select("canonical_name", "frequency", F.array_join("all_raw_identifiers", ",").alias("raws"))


@query(f"""WITH {_OCC} SELECT split_name AS canonical_name, arg_min(definition, (-length(definition), ordinal, definition)) AS definition FROM occ GROUP BY 1""")
def longest_definitions(spark, d):
    return concepts.longest_definition(occurrences(spark, d))


@query(f"""WITH {_OCC}, d AS (SELECT occurrence_id, arg_max(definition, (ordinal, definition)) AS definition FROM occ GROUP BY 1)
SELECT o.file_path, count(*) AS n, count(DISTINCT d.definition) AS definitions FROM occ o LEFT JOIN d USING (occurrence_id) GROUP BY 1""")
def definition_join(spark, d):
    occ = occurrences(spark, d)
    defs = occ.select("occurrence_id", "definition", F.struct("ordinal", "definition").alias("ord"))
    return concepts.with_definitions(occ, defs).groupBy("file_path").agg(F.count("*").alias("n"), F.countDistinct("definition").alias("definitions"))


@query("""WITH d AS (SELECT *, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR || '42'), doc_id) AS pick FROM documents)
SELECT source, doc_id, pick FROM d WHERE n >= 8 AND pick <= 5""")
def stratified_sample(spark, d):
    return ranking.stratified(_t(spark, d, "documents").select("doc_id", "source"), "source", "doc_id", 8, 5).select("source", "doc_id", F.col("pick").cast("bigint").alias("pick"))


@query("SELECT doc_id FROM documents ORDER BY md5(doc_id::VARCHAR || '42'), doc_id LIMIT 100")
def random_sample(spark, d):
    return ranking.sampled(_t(spark, d, "documents").select("doc_id"), "doc_id", 100)


# --------------------------------------------------------------- co-occurrence


def _scored(d, spark, kind, **more):
    out = cooccurrence.cooccurrence(brand_baskets(spark, d), normalization=kind, threshold=None, **more)
    return out.select("a", "b", "cooccurrence_count", "source_total", "target_total", F.round("raw_score", 6).alias("score"))


_J = "SELECT a, b, n AS cooccurrence_count, ta AS source_total, tb AS target_total, round({}, 6) AS score FROM j"
_PMI = "log2((n / c) / ((ta / c) * (tb / c)))"


@query(f"WITH {_BASKETS} " + _J.format("n / (ta + tb - n)::DOUBLE"))
def cooc_jaccard(spark, d):
    return _scored(d, spark, "jaccard")


@query(f"WITH {_BASKETS} " + _J.format(_PMI))
def cooc_pmi(spark, d):
    return _scored(d, spark, "pmi")


@query(f"WITH {_BASKETS} " + _J.format(f"{_PMI} / -log2(n / c)"))
def cooc_npmi(spark, d):
    return _scored(d, spark, "npmi")


@query(f"""WITH {_BASKETS} SELECT a, b, dom AS dominant_subdomain, round(top / n::DOUBLE, 6) AS ratio, top / n::DOUBLE < 0.5 AS crossing,
round(CASE WHEN top / n::DOUBLE < 0.5 THEN 0.3 ELSE 1 END * (n / (ta + tb - n)::DOUBLE), 6) AS weight FROM j""")
def cooc_subdomain_penalty(spark, d):
    out = cooccurrence.cooccurrence(brand_baskets(spark, d), threshold=None)
    return out.select("a", "b", "dominant_subdomain", F.round("same_subdomain_ratio", 6).alias("ratio"), F.col("cross_subdomain").alias("crossing"), F.round("weight", 6).alias("weight"))


# --------------------------------------------------------------- vectors

_COS = """v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
sim AS (SELECT x.vec_id AS i, y.vec_id AS j, round(list_dot_product(x.e, y.e) / (x.n * y.n), 6) AS sim FROM v x JOIN v y ON x.vec_id < y.vec_id)"""


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb"), "label")


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sim WHERE sim >= 0.3) SELECT i, j, sim, rank FROM r WHERE rank <= 20")
def cosine_topk(spark, d):
    return synonyms.candidates(_vectors(spark, d), 0.3, 20).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rank FROM sim WHERE sim >= 0.3) SELECT i, j, sim, CASE WHEN sim >= 0.4 THEN 'naming_variant' ELSE 'semantic' END AS track FROM r WHERE rank <= 20")
def synonym_tracks(spark, d):
    return synonyms.tracks(synonyms.candidates(_vectors(spark, d), 0.3, 20), 0.4, 0.3, 0.4).select("i", "j", "sim", "track")


_EPS = """p AS (SELECT x.label AS name, x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label
  AND sqrt(list_sum(list_transform(list_zip(x.embedding, y.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) <= 1.2),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON r.b = p.a),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
lab AS (SELECT e.label AS name, e.vec_id AS id, (dense_rank() OVER (PARTITION BY e.label ORDER BY root) - 1)::INT AS cluster FROM embeddings e JOIN root ON e.vec_id = root.id)"""


@query(f"WITH RECURSIVE {_EPS} SELECT name, id, cluster FROM lab")
def sense_clusters(spark, d):
    return senses.clusters(_vectors(spark, d).withColumnRenamed("label", "name"), 1.2)


@query(f"WITH RECURSIVE {_EPS}, n AS (SELECT name, count(DISTINCT cluster) AS c FROM lab GROUP BY 1) SELECT count(*) FILTER (c > 1) AS concepts_with_multiple_meanings, count(*) AS total_concepts_checked, sum(c)::BIGINT AS total_clusters FROM n")
def polysemy_summary(spark, d):
    return senses.polysemy_summary(senses.clusters(_vectors(spark, d).withColumnRenamed("label", "name"), 1.2))


@query("""WITH e AS (SELECT label AS name, vec_id AS id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings),
c AS (SELECT name, k, avg(x) AS c FROM e GROUP BY ALL), f AS (SELECT name, id, round(sqrt(sum((x - c) ** 2)), 6) AS dist FROM e JOIN c USING (name, k) GROUP BY ALL)
SELECT name, 0 AS cluster, count(*) AS members, arg_min(id, (dist, id)) AS representative, round(1 - avg(dist), 4) AS distinctiveness FROM f GROUP BY name""")
def nearest_to_centre(spark, d):
    rows = _vectors(spark, d).withColumnRenamed("label", "name")
    return senses.representatives(rows, rows.select("name", "id", F.lit(0).alias("cluster")))


@query("WITH t AS (SELECT split_name, count(*) AS n, count(DISTINCT file_path) AS files, count(DISTINCT definition) AS ways FROM occ GROUP BY 1) SELECT * FROM t WHERE n >= 5 AND files >= 3 AND ways > 1".replace("WITH t", f"WITH {_OCC}, t"))
def polysemy_candidates(spark, d):
    return senses.worth_checking(occurrences(spark, d))


# --------------------------------------------------------------- graph


@query(f"WITH {_EDGES} SELECT type, count(*) AS n, round(avg(weight), 6) AS avg_weight FROM edges GROUP BY type")
def edge_counts(spark, d):
    return reports.edge_counts(edges(spark, d))


@query(f"WITH {_EDGES} SELECT count(*) AS total, sum((type = 'synonym')::INT)::BIGINT AS synonym, sum((type = 'co-occurrence')::INT)::BIGINT AS co_occurrence, sum((type = 'polysemy')::INT)::BIGINT AS polysemy FROM edges")
def edge_type_pivot(spark, d):
    return reports.type_pivot(edges(spark, d))


@query(f"""WITH {_EDGES}, n AS (SELECT 'C' || c_nationkey AS node FROM customer UNION SELECT src FROM edges UNION SELECT dst FROM edges),
g AS (SELECT node, count(*) AS k FROM both_ways GROUP BY 1), l AS (SELECT list_sort(list(k), 'DESC') AS l, max(k) AS m, avg(k) AS a FROM g)
SELECT m AS max_degree, round(a, 6) AS avg_degree, l[len(l) // 2 + 1] AS median_degree, (SELECT count(*) FROM n ANTI JOIN g USING (node)) AS isolated FROM l""")
def degree_summary(spark, d):
    lone = _t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey")).alias("node"))
    return reports.degree_summary(_nodes(spark, d).union(lone).distinct(), edges(spark, d))


@query(f"WITH {_EDGES} SELECT node, count(*) AS degree FROM both_ways GROUP BY node ORDER BY degree DESC, node LIMIT 20")
def degree_hubs(spark, d):
    return reports.hubs(edges(spark, d))


@query(f"WITH {_EDGES} SELECT src, dst, weight, track FROM edges WHERE type = 'synonym' AND track = 'semantic' ORDER BY weight DESC, src, dst LIMIT 20")
def strongest_semantic(spark, d):
    return reports.strongest(edges(spark, d), "synonym", where="track = 'semantic'").select("src", "dst", "weight", "track")


@query(f"WITH {_EDGES} SELECT src, dst, weight, subdomain FROM edges WHERE type = 'co-occurrence' AND subdomain = 'd1' ORDER BY weight DESC, src, dst LIMIT 20")
def strongest_in_subdomain(spark, d):
    return reports.strongest(edges(spark, d), "co-occurrence", where="subdomain = 'd1'").select("src", "dst", "weight", "subdomain")


@query(f"WITH {_OCC}, {_EDGES} SELECT count(DISTINCT split_name) AS total_concepts, count(*) AS total_occurrences, 0 AS polysemous_concepts, (SELECT count(*) FROM edges) AS total_relationships FROM occ")
def kg_totals(spark, d):
    return reports.totals(concepts.concepts(occurrences(spark, d)), edges(spark, d))


@query(f"""WITH {_OCC}, r AS (SELECT split_name, raw_identifier, count(*) AS n, min(ordinal) AS o FROM occ GROUP BY ALL), f AS (SELECT split_name, count(DISTINCT file_path) AS num_files FROM occ GROUP BY 1)
SELECT split_name AS canonical_name, sum(n)::BIGINT AS frequency, array_to_string(list(raw_identifier ORDER BY o, raw_identifier)[:5], ',') AS raw_identifiers, any_value(num_files) AS num_files FROM r JOIN f USING (split_name) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30""")
def top_concepts(spark, d):
    occ = occurrences(spark, d)
    cf = occ.select(F.col("split_name").alias("concept"), F.col("file_path").alias("file"))
    return reports.top_concepts(concepts.concepts(occ), cf).withColumn("raw_identifiers", F.array_join("raw_identifiers", ","))


@query(f"""WITH RECURSIVE {_EPS}, s AS (SELECT name, cluster, 'sense ' || min(id) AS said FROM lab GROUP BY ALL)
SELECT 'c' || name AS canonical_name, count(*) AS num_meanings, string_agg(said, ',' ORDER BY cluster) AS meanings FROM s GROUP BY name HAVING count(*) > 1 ORDER BY 2 DESC, 1 LIMIT 15""")
def most_senses(spark, d):
    label = senses.clusters(_vectors(spark, d).withColumnRenamed("label", "name"), 1.2).groupBy(F.concat(F.lit("c"), "name").alias("concept"), "cluster").agg(F.min("id").alias("first"))
    listed = label.select("concept", "cluster", F.concat(F.lit("sense "), "first").alias("canonical_definition"), F.array("first").alias("occurrence_ids"), F.lit(0.0).alias("distinctiveness"))
    return reports.most_senses(assembly.senses_by_concept(listed)).select("canonical_name", F.col("num_meanings").cast("bigint").alias("num_meanings"), F.array_join("meanings", ",").alias("meanings"))


@query(f"WITH {_OCC} SELECT split_name AS canonical_name, count(*) AS frequency FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def most_frequent_concepts(spark, d):
    return reports.most_frequent(concepts.concepts(occurrences(spark, d))).select("canonical_name", "frequency")


@query(f"WITH {_EDGES} SELECT nbr, type, weight, coalesce(track, subdomain, '') AS detail FROM both_ways WHERE node = 'N3' ORDER BY weight DESC, nbr, type LIMIT 20")
def ego_network(spark, d):
    return reports.ego(edges(spark, d), "N3")


@query(f"WITH {_OCC} SELECT DISTINCT split_name AS canonical_name FROM occ WHERE contains(split_name, 'nd1') OR contains(lower(raw_identifier), 'nd1')")
def concept_search(spark, d):
    return reports.search(concepts.concepts(occurrences(spark, d)), "nd1").select("canonical_name")


@query(f"WITH {_EDGES}, n AS (SELECT 'S' || l_suppkey AS node FROM lineitem UNION SELECT 'C' || c_custkey FROM customer), e AS (SELECT DISTINCT node FROM adj) SELECT count(*) AS nodes, count(e.node) AS linked, round(avg((e.node IS NULL)::INT), 6) AS isolated_share FROM n LEFT JOIN e USING (node)")
def connectivity(spark, d):
    mine = _t(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("node"))
    return reports.connectivity(mine.union(_t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")))), edges(spark, d))


@query("SELECT c_mktsegment AS layer, count(*) AS n FROM customer GROUP BY 1")
def layer_histogram(spark, d):
    return reports.histogram(_t(spark, d, "customer").withColumnRenamed("c_mktsegment", "layer"), "layer")


@query(f"""WITH {_EDGES}, {_CF}, f AS (SELECT concept, count(*) AS file_count, array_to_string(list_sort(list(file))[:15], ',') AS files FROM cf GROUP BY 1),
n AS (SELECT node AS concept, string_agg(nbr, ',' ORDER BY nbr) AS neighbours FROM adj GROUP BY 1), t AS (SELECT count(DISTINCT file)::DOUBLE AS t FROM cf)
SELECT s AS concept, file_count, files, neighbours, round(ln(1 + t / greatest(file_count, 1)), 6) AS idf FROM (SELECT 'S' || s_suppkey AS s FROM supplier) JOIN f ON s = f.concept JOIN n ON s = n.concept, t""")
def concept_cards(spark, d):
    cf = concept_file(spark, d)
    names = _t(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("canonical_name"), F.lit("a supplier").alias("definition"))
    total = cf.agg(F.countDistinct("file")).first()[0]
    cards = graph.concept_cards(names, edges(spark, d), cf, total).where("file_count > 0")
    return cards.select("concept", "file_count", F.array_join("files", ",").alias("files"), F.array_join(F.transform("neighbours", lambda x: x["nbr"]), ",").alias("neighbours"), F.round("idf", 6).alias("idf"))


@query(f"""WITH {_CF}, a AS (SELECT DISTINCT 'S' || (c_custkey % 150) AS name FROM customer), f AS (SELECT concept AS name, count(*) AS df FROM cf GROUP BY 1), t AS (SELECT count(DISTINCT file)::DOUBLE AS n FROM cf)
SELECT name, df IS NOT NULL AS known, CASE WHEN df IS NULL THEN 1.0::DOUBLE ELSE round(ln(1 + n / greatest(df, 1)), 6) END AS idf FROM a LEFT JOIN f USING (name), t""")
def concept_lookup(spark, d):
    cf = concept_file(spark, d)
    names = _t(spark, d, "customer").select(F.concat(F.lit("S"), F.col("c_custkey") % 150).alias("name"))
    known = graph.exists(names, cf.select(F.col("concept").alias("canonical_name")))
    return known.join(graph.idf_of(names, cf), "name").select("name", "known", F.round("idf", 6).alias("idf"))


_SEEDS = "seed(node, weight) AS (VALUES ('S0', 1.0::DOUBLE), ('N3', 0.8::DOUBLE))"


def _seeds(spark):
    return spark.createDataFrame([("S0", 1.0), ("N3", 0.8)], "node string, weight double")


@query(f"""WITH {_EDGES}, {_SEEDS}, h1 AS (SELECT nbr AS node, max(weight * 0.5) AS weight FROM seed JOIN adj USING (node) GROUP BY 1), h2 AS (SELECT nbr AS node, max(weight * 0.5) AS weight FROM h1 JOIN adj USING (node) GROUP BY 1),
h3 AS (SELECT nbr AS node, max(weight * 0.5) AS weight FROM h2 JOIN adj USING (node) GROUP BY 1)
SELECT node, max(weight) AS weight FROM (FROM seed UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY node""")
def bfs_decay(spark, d):
    return graph.bfs(_seeds(spark), edges(spark, d))


@query(f"""WITH {_EDGES}, {_SEEDS}, n AS (SELECT node FROM seed UNION SELECT nbr FROM adj SEMI JOIN seed USING (node))
SELECT src, dst, type, max(weight) AS weight FROM edges WHERE src IN (FROM n) AND dst IN (FROM n) GROUP BY ALL""")
def subgraph(spark, d):
    return graph.subgraph(_seeds(spark), edges(spark, d))


@query(f"""WITH {_EDGES}, h0 AS (SELECT 'S5' AS node, ['S5'] AS path), h1 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h0 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1),
h2 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h1 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1), h3 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h2 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1),
h4 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h3 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1),
f AS (SELECT 1 AS hops, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3 UNION ALL SELECT 4, * FROM h4)
SELECT 'S5' AS source, 'S0' AS target, hops, array_to_string(path, '>') AS path FROM f WHERE node = 'S0' ORDER BY hops, f.path LIMIT 1""")
def shortest_path(spark, d):
    return graph.shortest_path(edges(spark, d), "S5", "S0").withColumn("path", F.array_join("path", ">"))


_NEXT = "SELECT source, nbr AS node, min(path || [nbr]) AS path FROM {} JOIN adj USING (node) GROUP BY ALL"


@query(f"""WITH {_EDGES}, p AS (SELECT DISTINCT 'S' || s_suppkey AS source, 'R' || (s_suppkey % 5) AS target FROM supplier), h0 AS (SELECT DISTINCT source, source AS node, [source] AS path FROM p),
h1 AS ({_NEXT.format("h0")}), h2 AS ({_NEXT.format("h1")}), h3 AS ({_NEXT.format("h2")}), f AS (SELECT 1 AS hops, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3)
SELECT source, target, hops, array_to_string(path, '>') AS path FROM p JOIN f USING (source) WHERE node = target QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY hops) = 1""")
def shortest_paths(spark, d):
    k = F.col("s_suppkey")
    pairs = _t(spark, d, "supplier").select(F.concat(F.lit("S"), k).alias("source"), F.concat(F.lit("R"), k % 5).alias("target"))
    return graph.shortest_paths(pairs, edges(spark, d)).withColumn("path", F.array_join("path", ">"))


_S5_PATH = f"""{_EDGES}, h0 AS (SELECT 'S5' AS node, ['S5'] AS path), h1 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h0 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1),
h2 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h1 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1), h3 AS (SELECT nbr AS node, min(path || [nbr]) AS path FROM h2 JOIN adj USING (node) WHERE NOT list_contains(path, nbr) GROUP BY 1),
f AS (SELECT 1 AS hops, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3), best AS (SELECT path FROM f WHERE node = 'S0' ORDER BY hops, path LIMIT 1)"""


@query(f"""WITH {_S5_PATH}, st AS (SELECT i::INT AS step, path[i + 1] AS src, path[i + 2] AS dst FROM (SELECT path, unnest(range(0, len(path) - 1)) AS i FROM best))
SELECT 'S5' AS source, 'S0' AS target, step, src, dst, arg_max(type, (weight, type)) AS type, max(weight) AS weight FROM st JOIN both_ways ON node = src AND nbr = dst GROUP BY ALL""")
def explained_path(spark, d):
    e = edges(spark, d)
    return graph.explained(graph.shortest_path(e, "S5", "S0"), e)


_IMPACT = f"""WITH {_EDGES}, {_CF}, loc AS (SELECT file AS changed, concept AS node, 0 AS d FROM cf WHERE file IN ('o7', 'o19')),
reach AS (SELECT changed, node, min(d) AS d FROM (FROM loc UNION ALL SELECT changed, nbr, 1 FROM loc JOIN adj USING (node)) GROUP BY ALL),
hit AS (SELECT changed, file, bool_or(d = 0) AS direct, count(DISTINCT node) AS shared FROM reach JOIN cf ON node = concept WHERE file <> changed GROUP BY ALL HAVING bool_or(d = 0) OR NOT (contains(file, changed) OR contains(changed, file)))"""


def _changed(spark):
    return spark.createDataFrame([("o7",), ("o19",)], "changed string")


@query(_IMPACT + " SELECT * FROM hit")
def reverse_impact(spark, d):
    return graph.impact(_changed(spark), edges(spark, d), concept_file(spark, d))


@query(_IMPACT + " SELECT file, bool_or(direct) AS direct, max(shared) AS shared FROM hit WHERE file NOT IN ('o7', 'o19') GROUP BY file ORDER BY 2 DESC, 3 DESC, file LIMIT 20")
def impact_report(spark, d):
    return graph.impact_report(_changed(spark), edges(spark, d), concept_file(spark, d))


_WALK = f"""WITH {_EDGES}, {_SEEDS}, {_CF}, common AS (SELECT concept FROM cf GROUP BY 1 HAVING count(*) > 0.042 * (SELECT count(DISTINCT file) FROM cf)),
g AS (SELECT node, nbr, max(weight * CASE WHEN type = 'co-occurrence' THEN 0.5 WHEN track = 'semantic' THEN 0.2 ELSE 1.0 END) AS gain FROM both_ways WHERE node NOT IN (FROM common) AND nbr NOT IN (FROM common) GROUP BY ALL),
h1 AS (SELECT nbr AS node, max(weight * gain) AS weight FROM seed JOIN g USING (node) WHERE weight * gain >= 0.01 GROUP BY 1), h2 AS (SELECT nbr AS node, max(weight * gain) AS weight FROM h1 JOIN g USING (node) WHERE weight * gain >= 0.01 GROUP BY 1),
h3 AS (SELECT nbr AS node, max(weight * gain) AS weight FROM h2 JOIN g USING (node) WHERE weight * gain >= 0.01 GROUP BY 1)
SELECT node, round(max(weight), 6) AS weight FROM (FROM seed UNION ALL FROM h1 UNION ALL FROM h2 UNION ALL FROM h3) GROUP BY node"""


@query(_WALK)
def weighted_walk(spark, d):
    return graph.walk(_seeds(spark), edges(spark, d), concept_file(spark, d), ratio=0.042).select("node", F.round("weight", 6).alias("weight"))


_HOP = "SELECT nbr AS node, arg_max(path || [nbr], (weight * gain, node, type)) AS path, max(weight * gain) AS weight, arg_max(node, (weight * gain, node, type)) AS via FROM {} JOIN g USING (node) WHERE weight * gain >= 0.01 GROUP BY 1"


@query(f"""WITH {_EDGES}, {_SEEDS}, {_CF}, common AS (SELECT concept FROM cf GROUP BY 1 HAVING count(*) > 0.042 * (SELECT count(DISTINCT file) FROM cf)),
k AS (SELECT node, nbr, type, weight * CASE WHEN type = 'co-occurrence' THEN 0.5 WHEN track = 'semantic' THEN 0.2 ELSE 1.0 END AS gain FROM both_ways WHERE node NOT IN (FROM common) AND nbr NOT IN (FROM common)),
g AS (SELECT node, nbr, max(gain) AS gain, arg_max(type, (gain, type)) AS type FROM k GROUP BY ALL), h0 AS (SELECT node, [node] AS path, weight, NULL::VARCHAR AS via FROM seed),
h1 AS ({_HOP.format("h0")}), h2 AS ({_HOP.format("h1")}), h3 AS ({_HOP.format("h2")}), f AS (SELECT 0 AS hop, * FROM h0 UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2 UNION ALL SELECT 3, * FROM h3)
SELECT node, path[1] AS seed, array_to_string(path, '>') AS path FROM f QUALIFY row_number() OVER (PARTITION BY node ORDER BY weight DESC, hop, via NULLS FIRST) = 1""")
def walk_paths(spark, d):
    found = graph.walk(_seeds(spark), edges(spark, d), concept_file(spark, d), ratio=0.042)
    return found.select("node", "seed", F.array_join(F.transform("path", lambda s: s["concept"]), ">").alias("path"))


@query(f"WITH {_CF} SELECT file, concept FROM cf WHERE file = (SELECT file FROM cf WHERE file = 'o12' OR ends_with(file, 'o12') OR ends_with('o12', file) OR contains(file, 'o12') ORDER BY file = 'o12' DESC, length(file) DESC, file LIMIT 1)")
def concepts_in_file(spark, d):
    return graph.concepts_in_file(concept_file(spark, d), "o12")


# --------------------------------------------------------------- retrieval


def _bm(spark, d):
    return bm25.topk(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


_CODE = "flatten(list_transform(list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]+'), lambda t: lower(t)), lambda t: list_concat([t], CASE WHEN contains(t, '_') THEN list_filter(string_split(t, '_'), lambda p: length(p) >= 2) ELSE [] END)))"
_BM25 = f"""dt AS (SELECT doc_id, {_CODE} AS l FROM documents), dl AS (SELECT doc_id, len(l) AS dl, l FROM dt WHERE len(l) > 0),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(l) AS term FROM dl) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score FROM q JOIN tf USING (term) JOIN df USING (term), st GROUP BY ALL),
bm AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM sc QUALIFY rank <= 10)"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_topk(spark, d):
    return _bm(spark, d)


def _truth(spark, d):
    return evaluation.holding(_t(spark, d, "documents"), _t(spark, d, "benchmark"))


_TRUTH = "truth AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_EVAL = "count(*) AS n, round(avg((rank IS NOT NULL)::INT), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce((rank = 1)::INT, 0)), 6) AS top1"


@query(f"WITH {_BM25}, {_TRUTH}, h AS (SELECT item_id, min(rank) AS rank FROM (SELECT DISTINCT item_id FROM truth) LEFT JOIN (SELECT item_id, rank FROM bm SEMI JOIN truth USING (item_id, doc_id)) USING (item_id) GROUP BY 1) SELECT {_EVAL} FROM h")
def bm25_eval(spark, d):
    return evaluation.summary(evaluation.first_hits(_bm(spark, d), _truth(spark, d), "item_id", "doc_id"))


@query(f"""WITH {_BM25}, {_TRUTH}, h AS (SELECT item_id, min(rank) AS rank FROM (SELECT DISTINCT item_id FROM truth) LEFT JOIN (SELECT item_id, rank FROM bm SEMI JOIN truth USING (item_id, doc_id)) USING (item_id) GROUP BY 1),
g AS (SELECT h.*, 'k' || (item_id % 3) AS category FROM h) SELECT category, {_EVAL} FROM g GROUP BY ROLLUP (category)""")
def eval_by_category_rollup(spark, d):
    hits = evaluation.first_hits(_bm(spark, d), _truth(spark, d), "item_id", "doc_id")
    return evaluation.summary(hits.withColumn("category", F.concat(F.lit("k"), F.col("item_id") % 3)), by=["category"], rollup=True)


@query(f"""WITH {_BM25}, {_TRUTH}, h AS (SELECT truth.item_id, source, count(bm.doc_id) > 0 AS hit FROM truth JOIN documents USING (doc_id) LEFT JOIN bm USING (item_id, doc_id) GROUP BY ALL)
SELECT source, count(*) AS total, sum(hit::INT)::BIGINT AS hits FROM h GROUP BY source HAVING count(*) >= 2""")
def subdomain_hits(spark, d):
    rows = _truth(spark, d).join(_t(spark, d, "documents").select("doc_id", "source"), "doc_id").join(_bm(spark, d).select("item_id", "doc_id", F.lit(1).alias("hit")), ["item_id", "doc_id"], "left")
    rows = rows.groupBy("item_id", "source").agg(F.max(F.coalesce("hit", F.lit(0))).alias("hit"))
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.sum("hit").cast("bigint").alias("hits")).where("total >= 2")


def _doc_concepts(spark, d):
    """Names of documents' sources as concepts, with the languages seen there as identifiers."""
    rows = _t(spark, d, "documents").select(F.explode(T.code_tokens(F.col("text"))).alias("w"), "lang").where(F.length("w") >= 12)
    return rows.groupBy(F.col("w").alias("canonical_name")).agg(F.array_sort(F.collect_set(F.concat_ws("_", "lang", F.substring("w", 1, 6)))).alias("all_raw_identifiers"))


_DC = f"c AS (SELECT w AS name, list_sort(list(DISTINCT lang || '_' || w[:6])) AS raws FROM (SELECT unnest({_CODE}) AS w, lang FROM documents) WHERE length(w) >= 12 GROUP BY w)"


@query(f"""WITH {_DC}, {_ISSUES}, ix AS (SELECT DISTINCT name AS concept, unnest(list_transform(list_concat([name], raws), lambda x: lower(x))) AS token FROM c),
a AS (SELECT DISTINCT issue_id, unnest({_TOKENS}) AS w FROM issues), ex AS (SELECT issue_id, w, concept, CASE WHEN token = concept THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END AS s FROM a JOIN ix ON w = token),
ixs AS (SELECT DISTINCT concept, {_STEM.replace('w', 'w')} AS stem FROM (SELECT concept, token AS w FROM ix)), st AS (SELECT issue_id, w, concept, 0.3::DOUBLE AS s FROM (SELECT *, {_STEM} AS stem FROM a) JOIN ixs USING (stem) ANTI JOIN ex USING (issue_id, w, concept))
SELECT issue_id, concept, round(max(s) * 0.3, 6) AS weight FROM (FROM ex UNION ALL FROM st) GROUP BY ALL""")
def token_seeds(spark, d):
    return retrieval.token_seeds(issues(spark, d), retrieval.token_index(_doc_concepts(spark, d))).select("issue_id", "concept", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_COS}, a AS (SELECT i AS issue_id, j AS concept, sim * 0.7::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS r FROM sim WHERE sim >= 0.15) WHERE r <= 10),
b AS (SELECT vec_id AS issue_id, vec_id + 1 AS concept, 0.3::DOUBLE * (vec_id % 2)::DOUBLE AS weight FROM embeddings), m AS (SELECT issue_id, concept, max(weight) AS weight FROM (FROM a UNION ALL FROM b) GROUP BY ALL)
SELECT issue_id, concept, round(weight, 8) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY issue_id ORDER BY weight DESC, concept) AS r FROM m) WHERE r <= 10""")
def seed_merge(spark, d):
    sim = similar_pairs(_vectors(spark, d), 0.15, k=10).select(F.col("i").alias("issue_id"), F.col("j").alias("concept"), "sim")
    other = _t(spark, d, "embeddings").select(F.col("vec_id").alias("issue_id"), (F.col("vec_id") + 1).alias("concept"), (0.3 * (F.col("vec_id") % 2)).alias("weight"), F.lit("token").alias("reason"))
    return retrieval.merged_seeds([retrieval.semantic_seeds(sim, k=10), other], 10).select("issue_id", "concept", F.round("weight", 8).alias("weight"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings),
sim AS (SELECT x.vec_id AS issue_id, y.vec_id AS concept, round(list_dot_product(x.e, y.e) / (x.n * y.n), 6) AS sim FROM v x, v y)
SELECT issue_id, concept, sim, row_number() OVER (PARTITION BY issue_id ORDER BY sim DESC, concept) AS rank FROM sim WHERE sim >= 0.15 QUALIFY rank <= 10""")
def issue_concept_similarity(spark, d):
    rows = _vectors(spark, d)
    found = similar_across(rows.withColumnRenamed("id", "issue_id"), rows.withColumnRenamed("id", "concept"), 0.15, 10)
    return ranking.top(found, ["issue_id"], [F.desc("sim"), "concept"], 10).withColumn("rank", F.col("rank").cast("bigint"))


_W = "w AS (SELECT s_suppkey AS issue_id, 'brand' || (s_suppkey % 25 + 1) || '_' || n AS concept, n / 20::DOUBLE AS weight FROM supplier, range(1, 20) r(n))"


def _concept_weights(spark, d):
    return _t(spark, d, "supplier").select(F.col("s_suppkey").alias("issue_id"), F.explode(F.sequence(F.lit(1), F.lit(19))).alias("n")).select("issue_id", F.concat(F.lit("brand"), F.col("issue_id") % 25 + 1, F.lit("_"), F.col("n")).alias("concept"), (F.col("n") / 20).alias("weight"))


_RANKED = f"""{_OCC}, {_W}, df AS (SELECT split_name AS concept, count(DISTINCT file_path) AS df FROM occ GROUP BY 1), tot AS (SELECT file_path, count(DISTINCT split_name) AS t FROM occ GROUP BY 1), nf AS (SELECT count(DISTINCT file_path)::DOUBLE AS nf FROM occ),
hit AS (SELECT issue_id, o.file_path, function_name, concept, sum(weight) * ln(1 + any_value(nf) / greatest(any_value(df), 1)) AS s FROM w JOIN occ o ON o.split_name = concept JOIN df USING (concept), nf GROUP BY ALL),
sc AS (SELECT issue_id, file_path, count(DISTINCT concept)::INT AS n_concepts, round(sum(s) * (1 + 0.4::DOUBLE * count(DISTINCT concept) / any_value(t)), 4) AS score FROM hit JOIN tot USING (file_path) GROUP BY ALL),
rk AS (SELECT issue_id, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path))::INT AS rank, file_path, score, n_concepts FROM sc QUALIFY rank <= 10)"""


def _ranked(spark, d):
    occ = occurrences(spark, d)
    return retrieval.file_scores(_concept_weights(spark, d), occ, occ.agg(F.countDistinct("file_path")).first()[0])


@query(f"WITH {_RANKED} SELECT * FROM rk")
def file_ranking_density(spark, d):
    return _ranked(spark, d).select("issue_id", "rank", "file_path", "score", "n_concepts")


@query(f"""WITH {_RANKED}, fn AS (SELECT issue_id, file_path, function_name, round(sum(s), 4) AS score FROM hit SEMI JOIN rk USING (issue_id, file_path) GROUP BY ALL)
SELECT issue_id, file_path, function_name, score, (row_number() OVER (PARTITION BY issue_id, file_path ORDER BY score DESC, function_name))::INT AS place FROM fn QUALIFY place <= 5""")
def top_functions(spark, d):
    rows = _ranked(spark, d).select("issue_id", "file_path", F.posexplode("top_functions").alias("p", "f"))
    return rows.select("issue_id", "file_path", F.col("f.name").alias("function_name"), F.col("f.score").alias("score"), (F.col("p") + 1).alias("place"))


_LOCKED = _RANKED.replace("JOIN df USING (concept), nf GROUP", "JOIN df USING (concept), nf WHERE NOT (ends_with(concept, '_5') AND ordinal % 2 = 1 AND concept IN (SELECT split_name FROM occ WHERE ordinal % 2 = 0)) GROUP")


@query(f"WITH {_LOCKED} SELECT * FROM rk")
def sense_locked_ranking(spark, d):
    occ, weights = occurrences(spark, d), _concept_weights(spark, d)
    even = occ.where("ordinal % 2 = 0").select(F.col("split_name").alias("concept"), F.lit("even").alias("sense"), "occurrence_id")
    named = even.select("concept", "sense").where(F.endswith("concept", F.lit("_5"))).distinct()
    locked = weights.join(named, "concept").select("issue_id", "concept", "sense")
    return retrieval.file_scores(weights, occ, occ.agg(F.countDistinct("file_path")).first()[0], locked=locked, senses=even).select("issue_id", "rank", "file_path", "score", "n_concepts")


@query(f"""WITH {_RANKED}, sk AS (SELECT issue_id, file_path, function_name, count(DISTINCT concept) AS n FROM hit SEMI JOIN rk USING (issue_id, file_path) GROUP BY ALL),
pk AS (SELECT *, row_number() OVER (PARTITION BY issue_id, file_path ORDER BY n DESC, function_name) AS r FROM sk QUALIFY r <= 10),
lg AS (SELECT file_path, function_name, arg_max(definition, (length(definition), -ordinal, definition)) AS snippet FROM occ GROUP BY ALL)
SELECT issue_id, file_path, md5(string_agg('# ' || function_name || chr(10) || snippet, chr(10) || chr(10) ORDER BY r)) AS digest FROM pk JOIN lg USING (file_path, function_name) GROUP BY ALL""")
def skeletons(spark, d):
    made = retrieval.skeletons(_ranked(spark, d), occurrences(spark, d).withColumnRenamed("definition", "code_snippet"))
    return made.select("issue_id", "file_path", F.md5("skeleton").alias("digest"))


_SOFT = "soft AS (SELECT DISTINCT lower(p_type) || (p_size % 10) AS token, 'pkg' || (l_suppkey % 5) || '/s' || l_suppkey || '.py' AS file_path FROM lineitem JOIN part ON l_partkey = p_partkey), iss AS (SELECT s_suppkey AS issue_id, 'standard' || (s_suppkey % 10) || ' economy' || (s_suppkey % 7) || ' small1' AS text FROM supplier)"


def _soft(spark, d):
    li, p = _t(spark, d, "lineitem"), _t(spark, d, "part")
    soft = li.join(p, li.l_partkey == p.p_partkey).select(F.concat(F.lower("p_type"), F.col("p_size") % 10).alias("token"), F.concat(F.lit("pkg"), F.col("l_suppkey") % 5, F.lit("/s"), F.col("l_suppkey"), F.lit(".py")).alias("file_path")).distinct()
    k = F.col("s_suppkey")
    return soft, _t(spark, d, "supplier").select(k.alias("issue_id"), F.concat(F.lit("standard"), k % 10, F.lit(" economy"), k % 7, F.lit(" small1")).alias("text"))


_BOOST = f"""{_SOFT}, ask AS (SELECT DISTINCT issue_id, unnest({_TOKENS}) AS token FROM iss), sdf AS (SELECT token, count(*) AS df FROM soft GROUP BY 1), sn AS (SELECT count(DISTINCT file_path)::DOUBLE AS n FROM soft),
orph AS (SELECT issue_id, file_path, sum(ln(1 + n / greatest(df, 1))) AS s FROM ask JOIN soft USING (token) JOIN sdf USING (token), sn WHERE token <> 'small1' GROUP BY ALL)"""


def _soft_parts(spark, d):
    soft, iss = _soft(spark, d)
    soft = cut(soft)
    names = spark.createDataFrame([("small1",)], "canonical_name string")
    return iss, soft, names, soft.agg(F.countDistinct("file_path")).first()[0]


@query(f"""WITH {_RANKED}, {_BOOST}, b AS (SELECT issue_id, file_path, round(score + coalesce(0.25 * s, 0), 4) AS score FROM rk LEFT JOIN orph USING (issue_id, file_path))
SELECT issue_id, file_path, score, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path))::INT AS rank FROM b""")
def soft_boost(spark, d):
    iss, soft, names, n = _soft_parts(spark, d)
    ranked = _ranked(spark, d)
    orphans = retrieval.orphan_tokens(iss, soft, names, among=ranked)
    return retrieval.boosted(ranked, retrieval.soft_boost(orphans, soft, n)).select("issue_id", "file_path", "score", "rank")


@query(f"WITH {_BOOST} SELECT issue_id, file_path, round(0.3 * s, 4) AS score, (row_number() OVER (PARTITION BY issue_id ORDER BY round(0.3 * s, 4) DESC, file_path))::INT AS rank FROM orph QUALIFY rank <= 10")
def soft_only_ranking(spark, d):
    iss, soft, names, n = _soft_parts(spark, d)
    return retrieval.soft_ranking(iss, soft, names, n).select("issue_id", "file_path", "score", "rank")


_CARDS = "cards AS (SELECT 'pkg' || (s_suppkey % 5) || '/s' || s_suppkey || '.py' AS file_path, ['the standard' || (s_suppkey % 10) || ' way', 'ECONOMY' || (s_suppkey % 7), 'other'] AS kc FROM supplier)"


def _cards(spark, d):
    k = F.col("s_suppkey")
    return _t(spark, d, "supplier").select(F.concat(F.lit("pkg"), k % 5, F.lit("/s"), k, F.lit(".py")).alias("file_path"), F.array(F.concat(F.lit("the standard"), k % 10, F.lit(" way")), F.concat(F.lit("ECONOMY"), k % 7), F.lit("other")).alias("key_concepts"), F.lit("core").alias("layer"))


@query(f"""WITH {_RANKED}, {_SOFT}, {_CARDS}, a AS (SELECT issue_id, {_TOKENS} AS tokens FROM iss),
b AS (SELECT issue_id, file_path, round(score * (1 + least(0.05 * len(list_filter(coalesce(kc, []), lambda c: len(list_filter(tokens, lambda t: contains(lower(c), t))) > 0)), 0.2)), 4) AS score FROM rk JOIN a USING (issue_id) LEFT JOIN cards USING (file_path))
SELECT issue_id, file_path, score, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path))::INT AS rank FROM b""")
def architecture_boost(spark, d):
    return retrieval.architecture_boost(_ranked(spark, d), _cards(spark, d), _soft(spark, d)[1]).select("issue_id", "file_path", "score", "rank")


@query(f"""WITH {_RANKED}, {_SOFT}, {_CARDS}, a AS (SELECT issue_id, {_TOKENS} AS tokens FROM iss),
b AS (SELECT issue_id, file_path, least(0.15::DOUBLE * len(list_filter(kc, lambda c: len(list_filter(tokens, lambda t: contains(lower(c), t) OR contains(t, lower(c)))) > 0)) + CASE WHEN list_contains(tokens, 'core') THEN 0.1::DOUBLE ELSE 0 END, 0.5) AS boost FROM rk JOIN a USING (issue_id) JOIN cards USING (file_path))
SELECT issue_id, file_path, round(boost, 6) AS boost FROM b WHERE boost > 0""")
def module_boost(spark, d):
    return retrieval.layer_boost(_ranked(spark, d), _cards(spark, d), _soft(spark, d)[1]).select("issue_id", "file_path", F.round("boost", 6).alias("boost"))


@query(f"""WITH {_CARDS}, f AS (SELECT 's' || s_suppkey || '.py' AS file_path, file_path AS card FROM supplier JOIN cards ON ends_with(file_path, '/s' || s_suppkey || '.py') UNION ALL SELECT 'none' || n_nationkey || '.py', NULL FROM nation)
SELECT f.file_path, CASE WHEN card IS NULL THEN 'unknown' ELSE 'core' END AS layer, coalesce(array_to_string(kc, ','), '') AS key_concepts FROM f LEFT JOIN cards ON card = cards.file_path""")
def module_lookup(spark, d):
    short = _t(spark, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey"), F.lit(".py")).alias("file_path"))
    asked = short.unionByName(_t(spark, d, "nation").select(F.concat(F.lit("none"), F.col("n_nationkey"), F.lit(".py")).alias("file_path")))
    return retrieval.module_info(asked, _cards(spark, d)).select("file_path", "layer", F.array_join("key_concepts", ",").alias("key_concepts"))


@query(f"""WITH {_CARDS}, t AS (SELECT 'Economy' || n_nationkey AS term FROM nation) SELECT term, file_path FROM t JOIN (SELECT file_path, lower(unnest(list_distinct(kc))) AS low FROM cards) ON low = lower(term)""")
def module_files_of_concept(spark, d):
    terms = _t(spark, d, "nation").select(F.concat(F.lit("Economy"), F.col("n_nationkey")).alias("term"))
    return retrieval.files_of_concepts(_cards(spark, d), terms)


@query(f"""WITH {_RANKED}, tr AS (SELECT s_suppkey AS issue_id, 'lib/pkg' || (s_suppkey % 5) || '/s' || s_suppkey || '.py' AS file_path, 'f' || (s_suppkey % 40) AS fn FROM supplier),
f5 AS (SELECT issue_id, file_path, function_name FROM (SELECT issue_id, file_path, function_name, round(sum(s), 4) AS score FROM hit SEMI JOIN rk USING (issue_id, file_path) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY issue_id, file_path ORDER BY score DESC, function_name) <= 5),
h AS (SELECT tr.issue_id, min(rk.rank) AS rank FROM tr LEFT JOIN (f5 JOIN rk USING (issue_id, file_path)) x ON x.issue_id = tr.issue_id AND x.function_name = tr.fn AND ends_with(tr.file_path, '/' || x.file_path) LEFT JOIN rk ON rk.issue_id = x.issue_id AND rk.file_path = x.file_path GROUP BY 1) SELECT {_EVAL} FROM h""")
def function_level_eval(spark, d):
    k = F.col("s_suppkey")
    truth = _t(spark, d, "supplier").select(k.alias("issue_id"), F.concat(F.lit("lib/pkg"), k % 5, F.lit("/s"), k, F.lit(".py")).alias("file_path"), F.concat(F.lit("f"), k % 40).alias("function"))
    return evaluation.summary(evaluation.first_function_hits(_ranked(spark, d), truth))


# --------------------------------------------------------------- routing, fusion

_PHRASES = ["Solr reindex fails", "MARC record import api", "refactor lending instead of loan", "the banner template shows a table of contents", "run the migration script in docker", "POST /lists/add endpoint returns 404", "boolean clause in search query", "nothing of note", "ISBN edition merge for the catalog", "waiting list of a patron"]


def routed_issues(spark, d):
    """Fixed phrases before the conversations' texts, in turn."""
    phrases = F.array(*[F.lit(p) for p in _PHRASES])
    return issues(spark, d).withColumn("text", F.concat_ws(" ", F.get(phrases, (F.col("issue_id") % len(_PHRASES)).cast("int")), "text"))


_ROUTED = f"{_ISSUES}, routed AS (SELECT issue_id, lower({_list(_PHRASES)}[(issue_id % {len(_PHRASES)} + 1)::INT] || ' ' || text) AS text FROM issues)"


def _router_sql() -> str:
    names = list(dict.fromkeys(c for c, _, _ in words.ROUTER_RULES))
    total = {n: " + ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN {w}::DOUBLE ELSE 0 END" for c, p, w in words.ROUTER_RULES if c == n) for n in names}
    scores = ", ".join(f"least(round({total[n]}, 6), 1.0::DOUBLE) AS {n}" for n in names)
    most = f"greatest({', '.join(names)})"
    pick = " ".join(f"WHEN {n} = {most} THEN '{n}'" for n in names)
    return f"WITH {_ROUTED}, s AS (SELECT issue_id, {scores} FROM routed) SELECT issue_id, CASE WHEN {most} = 0 THEN 'general' {pick} END AS category, CASE WHEN {most} = 0 THEN 0.3::DOUBLE ELSE {most} END AS confidence FROM s"


@query(_router_sql())
def router_classify(spark, d):
    return routing.classify(routed_issues(spark, d), F.col("text")).select("issue_id", "category", "confidence")


def _types_sql() -> str:
    parts = ", ".join(f"CASE WHEN {' OR '.join(f'''regexp_matches(text, '{p}')''' for p in ps)} THEN '{n}' END" for n, ps in words.ISSUE_TYPES.items())
    return f"WITH {_ROUTED}, t AS (SELECT issue_id, list_filter([{parts}], lambda x: x IS NOT NULL) AS l FROM routed), u AS (SELECT issue_id, unnest(CASE WHEN len(l) = 0 THEN ['other'] ELSE l END) AS type FROM t) SELECT type, count(*) AS n FROM u GROUP BY type"


@query(_types_sql())
def issue_type_matrix(spark, d):
    return reports.histogram(routing.issue_types(routed_issues(spark, d), F.col("text")), "type")


_RUNS = """g AS (SELECT o_custkey AS issue_id, 'core/f' || (o_orderkey % 50) AS file_path, round(sum(o_totalprice), 2) AS score FROM orders GROUP BY ALL), l AS (SELECT o_custkey AS issue_id, 'core/f' || (o_orderkey % 37) AS file_path, count(*)::DOUBLE AS score FROM orders GROUP BY ALL)"""


def _runs(spark, d):
    o = _t(spark, d, "orders")
    f = lambda m: F.concat(F.lit("core/f"), F.col("o_orderkey") % m)
    return o.groupBy(F.col("o_custkey").alias("issue_id"), f(50).alias("file_path")).agg(F.round(F.sum("o_totalprice"), 2).alias("score")), o.groupBy(F.col("o_custkey").alias("issue_id"), f(37).alias("file_path")).agg(F.count("*").cast("double").alias("score"))


_CATEGORY = "cat AS (SELECT c_custkey AS issue_id, ['marc_catalog', 'general', 'domain_logic'][(c_custkey % 3 + 1)::INT] AS category FROM customer)"


@query(f"""WITH {_RUNS}, {_CATEGORY}, a AS (SELECT issue_id, file_path, score / max(score) OVER (PARTITION BY issue_id) AS g FROM g), b AS (SELECT issue_id, file_path, score / max(score) OVER (PARTITION BY issue_id) AS l FROM l),
m AS (SELECT issue_id, file_path, coalesce(g, 0) AS g, coalesce(l, 0) AS l FROM a FULL JOIN b USING (issue_id, file_path)), s AS (SELECT issue_id, file_path, CASE WHEN category = 'marc_catalog' THEN 0.85::DOUBLE ELSE 0.4::DOUBLE END AS al, CASE WHEN category = 'general' THEN 1.0::DOUBLE ELSE 1.15::DOUBLE END AS bo, g, l FROM m LEFT JOIN cat USING (issue_id))
SELECT issue_id, file_path, round((al * l + (1 - al) * g) * bo, 8) AS score, (row_number() OVER (PARTITION BY issue_id ORDER BY round((al * l + (1 - al) * g) * bo, 8) DESC, file_path))::INT AS rank FROM s QUALIFY rank <= 10""")
def fusion_weighted(spark, d):
    g, l = _runs(spark, d)
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("issue_id"), F.get(F.array(F.lit("marc_catalog"), F.lit("general"), F.lit("domain_logic")), (F.col("c_custkey") % 3).cast("int")).alias("category"))
    return routing.weighted_fusion(g, l, c, digits=8)


@query(f"""WITH {_RUNS}, a AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY round(score, 2) DESC, file_path) AS g FROM g), b AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path) AS l FROM l),
s AS (SELECT issue_id, file_path, round(0.6::DOUBLE / (60 + coalesce(l, 50)) + 0.4::DOUBLE / (60 + coalesce(g, 50)), 8) AS score FROM a FULL JOIN b USING (issue_id, file_path))
SELECT issue_id, file_path, score, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path))::INT AS rank FROM s QUALIFY rank <= 10""")
def fusion_rrf(spark, d):
    g, l = _runs(spark, d)
    placed = lambda df: ranking.ranked(df.withColumn("score", F.round("score", 2)), ["issue_id"], [F.desc("score"), "file_path"])
    return routing.reciprocal_rank_fusion(placed(g), placed(l))


@query(f"""WITH {_RUNS}, {_CATEGORY}, a AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY round(score, 2) DESC, file_path) AS g FROM g), b AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path) AS l FROM l),
m AS (SELECT issue_id, file_path, coalesce(l, 50) AS l, coalesce(g, 50) AS g, CASE category WHEN 'marc_catalog' THEN 0.75::DOUBLE WHEN 'domain_logic' THEN 0.30::DOUBLE ELSE 0.50::DOUBLE END AS al, CASE WHEN category = 'general' THEN 1.0::DOUBLE ELSE 1.10::DOUBLE END AS bo FROM a FULL JOIN b USING (issue_id, file_path) LEFT JOIN cat USING (issue_id)),
s AS (SELECT issue_id, file_path, round((al / (60 + l) + (1 - al) / (60 + g)) * bo, 8) AS score FROM m)
SELECT issue_id, file_path, score, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path))::INT AS rank FROM s QUALIFY rank <= 10""")
def fusion_rrf_by_category(spark, d):
    g, l = _runs(spark, d)
    placed = lambda df: ranking.ranked(df.withColumn("score", F.round("score", 2)), ["issue_id"], [F.desc("score"), "file_path"])
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("issue_id"), F.get(F.array(F.lit("marc_catalog"), F.lit("general"), F.lit("domain_logic")), (F.col("c_custkey") % 3).cast("int")).alias("category"))
    return routing.reciprocal_rank_fusion(placed(g), placed(l), category=c)


@query(f"""WITH {_RUNS}, a AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY round(score, 2) DESC, file_path) AS rank FROM g), b AS (SELECT issue_id, file_path, row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file_path) AS rank FROM l),
tr AS (SELECT DISTINCT issue_id, 'core/f' || (issue_id % 40) AS file_path FROM g), ha AS (SELECT issue_id, least(coalesce(rank, 11), 11) AS r FROM tr LEFT JOIN a USING (issue_id, file_path)), hb AS (SELECT issue_id, least(coalesce(rank, 11), 11) AS r FROM tr LEFT JOIN b USING (issue_id, file_path))
SELECT c_mktsegment AS type, count(*) AS n, sum((ha.r <= 10)::INT)::BIGINT AS hits_a, sum((hb.r <= 10)::INT)::BIGINT AS hits_b, sum((ha.r = 1)::INT)::BIGINT AS top1_a, sum((hb.r = 1)::INT)::BIGINT AS top1_b, sum((ha.r < hb.r)::INT)::BIGINT AS better_a, sum((hb.r < ha.r)::INT)::BIGINT AS better_b
FROM ha JOIN hb USING (issue_id) JOIN customer ON issue_id = c_custkey GROUP BY 1""")
def methods_compared(spark, d):
    g, l = _runs(spark, d)
    placed = lambda df: ranking.ranked(df.withColumn("score", F.round("score", 2)), ["issue_id"], [F.desc("score"), "file_path"])
    truth = g.select("issue_id").distinct().withColumn("file_path", F.concat(F.lit("core/f"), F.col("issue_id") % 40))
    kinds = _t(spark, d, "customer").select(F.col("c_custkey").alias("issue_id"), F.col("c_mktsegment").alias("type"))
    return evaluation.compared(evaluation.first_hits(placed(g), truth), evaluation.first_hits(placed(l), truth), kinds)


# --------------------------------------------------------------- diffs, models, whole plans

_PATCH = "+++ b/pkg/a{0}.py\n@@ -1,3 +1,4 @@ def outer(x):\n class Ctx:\n+    async def added{1}(self):\n-    def removed(self):\n+++ b/web/a.js\n@@ -1 +1 @@ function f() {{\n+def not_python():"


@query("""SELECT s_suppkey AS issue_id, f.file, f.fn AS function FROM supplier, LATERAL (SELECT 'pkg/a' || (s_suppkey % 9) || '.py' AS file, unnest([NULL, 'Ctx', 'added' || (s_suppkey % 4), 'outer']) AS fn) f""")
def parse_patch(spark, d):
    k = F.col("s_suppkey")
    patches = _t(spark, d, "supplier").select(k.alias("issue_id"), F.format_string(_PATCH.format("%s", "%s"), (k % 9).cast("string"), (k % 4).cast("string")).alias("patch"))
    return diffs.parsed(patches)


@query("""WITH t AS (SELECT o_orderkey AS issue_number, o_custkey AS pr_number FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT c_custkey AS pr_number, list_sort(['n' || c_nationkey || '.py', 'a' || (c_custkey % 5) || '.py']) AS files FROM customer)
SELECT issue_number, pr_number, array_to_string(files, ',') AS files FROM t JOIN f USING (pr_number)""")
def ground_truth_join(spark, d):
    o, c = _t(spark, d, "orders"), _t(spark, d, "customer")
    found = o.select(F.col("o_orderkey").alias("issue_number"), F.lit(False).alias("is_pull_request"), F.when(F.col("o_orderstatus") == "F", "closed").otherwise("open").alias("state"))
    line = o.select(F.col("o_orderkey").alias("issue_number"), F.col("o_custkey").alias("pr_number"), F.lit(True).alias("merged"))
    files = c.select(F.col("c_custkey").alias("pr_number"), F.explode(F.array(F.concat(F.lit("n"), F.col("c_nationkey"), F.lit(".py")), F.concat(F.lit("a"), F.col("c_custkey") % 5, F.lit(".py")), F.lit("b.js"))).alias("file"))
    return diffs.merged_changes(found, line, files).select("issue_number", "pr_number", F.array_join("changed_files", ",").alias("files"))


@query(f"""WITH {_EDGES}, {_CF}, tm AS (SELECT c_custkey AS issue_id, unnest(['s' || (c_custkey % 90), 'unknown' || (c_custkey % 5), 'S' || (c_custkey % 7)]) AS t FROM customer), names AS (SELECT DISTINCT concept FROM cf), a AS (SELECT DISTINCT issue_id, lower(t) AS term FROM tm),
k AS (SELECT a.*, lower(concept) IS NOT NULL AS known FROM a LEFT JOIN names ON term = lower(concept)) SELECT issue_id, round(avg(known::INT), 6) AS share, CASE WHEN avg(known::INT) >= 0.6 THEN 'high' WHEN avg(known::INT) >= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM k GROUP BY 1""")
def oracle_confidence(spark, d):
    return _diagnosis(spark, d)["confidence"]


def _diagnosis(spark, d):
    k = F.col("c_custkey")
    terms = _t(spark, d, "customer").select(k.alias("issue_id"), F.explode(F.array(F.concat(F.lit("s"), k % 90), F.concat(F.lit("unknown"), k % 5), F.concat(F.lit("S"), k % 7))).alias("term"))
    low = lambda df, *c: df.select(*[F.lower(x).alias(x) if x in c else F.col(x) for x in df.columns])
    return models.diagnosed(terms, low(edges(spark, d), "src", "dst"), low(concept_file(spark, d), "concept"))


_TERMS = f"""{_EDGES}, {_CF}, tm AS (SELECT c_custkey AS issue_id, unnest(['s' || (c_custkey % 90), 'unknown' || (c_custkey % 5), 'S' || (c_custkey % 7)]) AS t FROM customer),
lcf AS (SELECT DISTINCT lower(concept) AS concept, file FROM cf), ladj AS (SELECT DISTINCT lower(node) AS node, lower(nbr) AS nbr FROM adj), a AS (SELECT DISTINCT issue_id, lower(t) AS term FROM tm), known AS (SELECT * FROM a WHERE term IN (SELECT concept FROM lcf))"""


@query(f"""WITH {_TERMS}, w AS (SELECT issue_id, concept, max(weight) AS weight FROM (SELECT issue_id, term AS concept, 1.0::DOUBLE AS weight FROM known UNION ALL SELECT issue_id, nbr, 0.5::DOUBLE FROM known JOIN ladj ON term = node) GROUP BY ALL),
df AS (SELECT concept, count(*) AS df FROM lcf GROUP BY 1), n AS (SELECT count(DISTINCT file)::DOUBLE AS n FROM lcf), sc AS (SELECT issue_id, file, round(sum(weight * ln(1 + n / greatest(df, 1))), 4) AS score FROM w JOIN df USING (concept) JOIN lcf USING (concept), n GROUP BY ALL)
SELECT issue_id, file, score, (row_number() OVER (PARTITION BY issue_id ORDER BY score DESC, file))::INT AS rank FROM sc QUALIFY rank <= 10""")
def oracle_files(spark, d):
    return _diagnosis(spark, d)["files"]


@query(f"""WITH {_TERMS}, f AS (SELECT issue_id, nbr AS concept FROM known JOIN ladj ON term = node QUALIFY row_number() OVER (PARTITION BY issue_id, term ORDER BY nbr) <= 3),
x AS (SELECT DISTINCT f.issue_id, f.concept FROM f ANTI JOIN known ON known.issue_id = f.issue_id AND known.term = f.concept) SELECT issue_id, concept FROM x QUALIFY row_number() OVER (PARTITION BY issue_id ORDER BY concept) <= 10""")
def oracle_suggestions(spark, d):
    k = F.col("c_custkey")
    terms = _t(spark, d, "customer").select(k.alias("issue_id"), F.explode(F.array(F.concat(F.lit("s"), k % 90), F.concat(F.lit("unknown"), k % 5), F.concat(F.lit("S"), k % 7))).alias("term"))
    low = lambda df, *c: df.select(*[F.lower(x).alias(x) if x in c else F.col(x) for x in df.columns])
    return models.suggested(terms, low(edges(spark, d), "src", "dst"), low(concept_file(spark, d), "concept"))


#: A small code base for the operators that read source code.
SOURCES = [
    ("catalog/records.py", "import json\nfrom catalog import merge\n\nclass RecordReader(Base):\n    limit: int = 3\n\n    def read_subjects(self, marc_record, *fields):\n        self.subjects = marc_record.subjects\n        return [field for field in fields]\n"),
    ("catalog/merge.py", "def merge_editions(edition_record, author_name):\n    subject_index = edition_record.subjects\n    return subject_index, author_name\n"),
    ("solr/updater.py", "import requests\nfrom catalog import records\n\nclass SolrUpdater:\n    def update_edition(self, edition_record):\n        solr_query = edition_record.author_name\n        self.author_name = solr_query\n        return requests.post(solr_query)\n"),
    ("core/lending.py", "def loan_status(patron_record, edition_record):\n    waiting_list = patron_record.waiting_list\n    author_name = edition_record.author_name\n    return waiting_list, author_name\n"),
    ("core/broken.py", "def (:\n"),
]


def _sources(spark):
    return spark.createDataFrame(SOURCES, "file_path string, text string")


def part_sources(spark, d):
    """A source file for every part, of one form: a class with a method, an element assigned, an attribute, a call, an import of the next part's."""
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(n)) for n in (1, 2))
    lines = [
        F.lit("import json as js"),
        F.concat(F.lit("class "), F.initcap(a), F.lit("(Base):")),
        F.concat(F.lit("    def read_"), b, F.lit("(self, arg_"), F.col("p_size"), F.lit("):")),
        F.concat(F.lit("        "), b, F.lit("_map['k'] = js.loads(arg_"), F.col("p_size"), F.lit(")")),
        F.concat(F.lit("        self."), a, F.lit("_size = "), F.col("p_size").cast("string")),
        F.concat(F.lit("top_"), a, F.lit(" = 1")),
        F.concat(F.lit("import m"), (F.col("p_partkey") + 1) % 7, F.lit(".p"), F.col("p_partkey") + 1),
    ]
    return _t(spark, d, "part").select(F.concat(F.lit("m"), F.col("p_partkey") % 7, F.lit("/p"), F.col("p_partkey"), F.lit(".py")).alias("file_path"), F.concat(F.concat_ws("\n", *lines), F.lit("\n")).alias("text"))


_PARTS = "p AS (SELECT 'm' || (p_partkey % 7) || '/p' || p_partkey || '.py' AS file_path, p_partkey AS k, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_size AS s FROM part)"
_FOUND = """found AS (SELECT file_path, unnest(['js', upper(a[1]) || a[2:], 'Base', 'read_' || b, 'self', 'arg_' || s, b || '_map', 'loads', a || '_size', a || '_size', 'top_' || a, 'm' || ((k + 1) % 7)]) AS raw_identifier,
unnest(['import', 'class_name', 'class_name', 'function_name', 'parameter', 'parameter', 'variable', 'attribute', 'variable', 'attribute', 'variable', 'import']) AS identifier_type, unnest([1, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7]) AS line_number FROM p)"""


@query(f"WITH {_PARTS}, {_FOUND} SELECT * FROM found")
def ast_extract(spark, d):
    return extraction.occurrences(part_sources(spark, d)).select("file_path", "raw_identifier", "identifier_type", "line_number")


@query(f"""WITH {_PARTS} SELECT file_path, '' AS responsibility, 'm' || (k % 7) AS layer, upper(a[1]) || a[2:] || ',read_' || b AS key_concepts, 2 AS symbol_count, 2 AS imports_from_count, (k - 1 IN (SELECT p_partkey FROM part))::INT AS imported_by_count FROM p""")
def module_cards(spark, d):
    found = cut(extraction.symbols(part_sources(spark, d)))
    cards = extraction.module_cards(found, found.select("file_path", F.lit("").alias("responsibility"), F.split_part("file_path", F.lit("/"), F.lit(1)).alias("layer"), F.slice("symbols", 1, 2).alias("key_concepts")))
    return cards.withColumn("key_concepts", F.array_join("key_concepts", ","))


@query("""WITH a AS (SELECT c_custkey AS issue_id, unnest(['core/f' || (c_custkey % 50) || '.py', 'a.py', 'pkg/b' || (c_custkey % 3) || '.py'][:CASE c_custkey % 4 WHEN 3 THEN 0 ELSE 3 END]) AS file_path, unnest([1, 2, 3][:CASE c_custkey % 4 WHEN 3 THEN 0 ELSE 3 END]) AS rank FROM customer)
SELECT issue_id, rank, file_path FROM a""")
def model_ranking(spark, d):
    k = F.col("c_custkey")
    quoted = lambda between: F.concat_ws(between, F.format_string('"core/f%s.py"', (k % 50).cast("string")), F.lit('"a.py"'), F.format_string('"pkg/b%s.py"', (k % 3).cast("string")))
    listed = F.concat(F.lit("["), quoted(", "), F.lit("]"))
    answer = F.when(k % 4 == 0, listed).when(k % 4 == 1, F.concat(F.lit("Likely ones:\n```json\n"), listed, F.lit("\n```\nin [that] order"))).when(k % 4 == 2, F.concat(F.lit("I would change "), quoted(" and "), F.lit("."))).otherwise("no idea")
    return models.ranked_answers(_t(spark, d, "customer").select(k.alias("issue_id"), answer.alias("answer")))


@query()
def graph_build(spark, d):
    return build(_sources(spark))["edges"]


def _asked(spark):
    return spark.createDataFrame([(1, "Solr query returns the wrong author", "edition records"), (2, "Loans", "patron record shows no waiting list"), (3, "refactor to use requests", "")], "issue_id bigint, title string, body string")


@query()
def localize_issues(spark, d):
    return localize(_asked(spark), build(_sources(spark)))


@query()
def hybrid_ranking(spark, d):
    return hybrid(_asked(spark), build(_sources(spark)), _sources(spark))


@query(f"WITH {_PARTS}, {_FOUND} SELECT raw_identifier, 'The ' || replace(identifier_type, '_', ' ') || ' ' || raw_identifier AS answer FROM found")
def cached_definitions(spark, d):
    prompts = models.definition_prompts(extraction.occurrences(part_sources(spark, d))).select("raw_identifier", "prompt")
    return models.through_cache(prompts, spark.createDataFrame([], "key string, answer string"))[0].select("raw_identifier", "answer")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
