"""Small goldens and properties."""

import itertools
import random

import duckdb
from pyspark.sql import functions as F

from lexigraph.functions import text as T
from lexigraph.functions.vectors import similar_across, similar_pairs
from lexigraph.operators import bm25, concepts, cooccurrence, diffs, evaluation, extraction, graph, models, ranking, retrieval, routing, senses
from lexigraph.plans.config import load
from lexigraph.sources.cache import CacheTable
from lexigraph.sources.files import json_if_there, text_files
from lexigraph.streaming.incremental import current, keep_current, source_stream


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_split_identifier(spark):
    for name, parts in {"get_user_name": "get user name", "getUserBookData": "get user book data", "ISBN_13_check": "isbn 13 check", "HTTPServer2x": "http server x", "abc123": "abc", "v2API": "v api", "ABCs": "ab cs", "OLId": "ol id", "": ""}.items():
        assert one(spark, name, T.split_identifier) == parts.split()


def test_concept_names(spark):
    for name, kept in {"format_languages": "languages", "read_subjects": "subjects", "new_solr_updater": "solr_updater", "ISBN_13_check": "ISBN_check", "JSON": "", "split": ""}.items():
        assert one(spark, name, T.concept_name) == kept


def test_light_stem(spark):
    for word, stem in {"logging": "logg", "logins": "login", "users": "user", "files": "fil", "issues": "issu", "queries": "query", "applied": "appl", "tied": "tied", "process": "proces", "is": "is"}.items():
        assert one(spark, word, T.light_stem) == stem


def test_cooccurrence_golden(spark):
    rows = [(c, x, s) for c, xs, s in [(1, "ab", "x"), (2, "ab", "y"), (3, "abc", "z"), (4, "c", "z")] for x in xs]
    members = spark.createDataFrame(rows, "context int, concept string, subdomain string")
    got = {k: cooccurrence.cooccurrence(members, normalization=k).collect() for k in cooccurrence.SCORES}
    assert [(r.a, r.b, r.cooccurrence_count, r.source_total) for r in got["jaccard"]] == [("a", "b", 3, 3)]
    assert round(got["jaccard"][0].weight, 6) == 0.3 and round(got["pmi"][0].raw_score, 6) == 0.415037 and round(got["npmi"][0].raw_score, 6) == 1.0


def test_bm25_golden(spark):
    docs = spark.createDataFrame([(0, "aa bb aa"), (1, "bb cc"), (2, "cc cc cc dd")], "doc_id int, text string")
    score = lambda q: {r.doc_id: round(r.score, 6) for r in bm25.scores(docs, spark.createDataFrame([(1, q)], "item_id int, text string")).collect()}
    assert score("aa bb") == {0: 1.871188, 1: 0.552945}
    assert score("aa aa") == {0: 2.802369}


def test_walk_and_bfs_goldens(spark):
    e = spark.createDataFrame([("a", "b", "synonym", 0.9, "naming_variant"), ("b", "c", "co-occurrence", 0.4, None), ("a", "c", "synonym", 0.8, "semantic")], "src string, dst string, type string, weight double, track string")
    seed = spark.createDataFrame([("a", 1.0)], "node string, weight double")
    assert {r.node: round(r.weight, 6) for r in graph.walk(seed, e).collect()} == {"a": 1.0, "b": 0.9, "c": 0.18}
    line = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    assert {r.node: r.weight for r in graph.bfs(seed, line, hops=2).collect()} == {"a": 1.0, "b": 0.5, "c": 0.25}


def test_walk_is_the_best_of_all_walks(spark):
    rng = random.Random(3)
    for _ in range(3):
        nodes = "abcdef"
        rows = [(x, y, "synonym", round(rng.uniform(0.2, 1), 2), "naming_variant") for x, y in itertools.combinations(nodes, 2) if rng.random() < 0.5]
        e = spark.createDataFrame(rows, "src string, dst string, type string, weight double, track string")
        near = {}
        for x, y, _, w, _ in rows:
            near.setdefault(x, []).append((y, w))
            near.setdefault(y, []).append((x, w))
        best, front = {"a": 1.0}, [("a", 1.0)]
        for _ in range(3):
            front = [(n, w * g) for x, w in front for n, g in near.get(x, []) if w * g >= 0.01]
            for n, w in front:
                best[n] = max(best.get(n, 0), w)
        got = graph.walk(spark.createDataFrame([("a", 1.0)], "node string, weight double"), e)
        assert {r.node: round(r.weight, 9) for r in got.collect()} == {n: round(w, 9) for n, w in best.items()}


def test_shortest_path_to_itself_and_to_nowhere(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    assert graph.shortest_path(e, "a", "a").first().path == ["a"]
    assert graph.shortest_path(e, "a", "z").count() == 0


def test_patch_golden(spark):
    patch = "+++ b/pkg/a.py\n@@ -1,3 +1,4 @@ def outer(x):\n class Ctx:\n+    async def added(self):\n-    def removed(self):\n+++ b/web/a.js\n@@ -1 +1 @@ function f() {\n+def not_python():"
    issues = spark.createDataFrame([(1, "", "t", "b", patch), (2, "", "t", "b", "")], "issue_id int, problem_statement string, title string, body string, patch string")
    row = diffs.ground_truth(issues).collect()
    assert len(row) == 1 and row[0].changed_files == ["pkg/a.py"] and row[0].text == "t\nb"
    assert [f.function for f in row[0].changed_functions] == ["Ctx", "added", "outer"]
    assert one(spark, "Fixes #12, closes #7", diffs.fixes) == ["12", "7"]


def test_router_goldens(spark):
    rows = spark.createDataFrame([(1, "Solr reindex fails"), (2, "MARC record"), (3, "refactor lending")], "issue_id int, text string")
    got = {r.issue_id: (r.category, r.confidence) for r in routing.classify(rows, F.col("text")).collect()}
    assert got == {1: ("solr_search", 1.0), 2: ("general", 0.3), 3: ("refactor", 1.0)}
    assert {r.issue_id: r.category for r in routing.classify(rows, F.col("text"), ignore_case=True).collect()}[2] == "marc_catalog"


def test_evaluation_golden(spark):
    told = spark.createDataFrame([(1, "x/a.py", 1), (2, "b.py", 4), (3, "q.py", 1)], "issue_id int, file_path string, rank int")
    truth = spark.createDataFrame([(1, "a.py"), (2, "b.py"), (3, "c.py")], "issue_id int, file_path string")
    row = evaluation.summary(evaluation.first_hits(told, truth, suffix=True)).first()
    assert (row.n, row.hit_rate, row.mrr) == (3, 0.666667, 0.416667)


def test_whole_passages_are_held(spark):
    opening = " ".join(f"word{i}" for i in range(20)) + " "
    passages = spark.createDataFrame([(1, opening + "ends here"), (2, opening + "goes on"), (3, "two words"), (4, None), (5, opening + "ends here")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "an " + opening + "ends hereafter"), (2, opening + "stops"), (3, "x" + opening + "goes on, two words"), (None, opening + "goes on"), (5, None), (6, "")], "doc_id int, text string")
    got = evaluation.holding(docs, passages).collect()
    assert sorted((r.item_id, r.doc_id or 0) for r in got) == [(1, 1), (2, 0), (2, 3), (3, 3), (5, 1)]
    assert {r.doc_id for r in got if r.item_id == 1} == {1}  # document 2 has the first 80 characters only


def test_identifiers_golden():
    source = "import os as o\nclass A(base.B):\n    def m(self, x):\n        self.y = x\n"
    got = [(r[2], r[3], r[8]) for r in extraction.identifiers("f.py", source)]
    assert got == [("o", "import", "module"), ("A", "class_name", "class"), ("B", "class_name", "class"), ("B", "attribute", "class"), ("m", "function_name", "method"), ("self", "parameter", "method"), ("x", "parameter", "method"), ("y", "variable", "method"), ("y", "attribute", "method")]
    assert extraction.identifiers("f.py", "def (") == []


def test_module_cards_count_all_symbols(spark):
    big = "class Big:\n" + "".join(f"    def f{i}(self): pass\n" for i in range(20)) + "    def _own(self): pass\n"
    files = spark.createDataFrame([("a.py", big), ("b.py", "def g(): pass"), ("c.py", "def ("), ("d.py", None)], "file_path string, text string")
    found = extraction.symbols(files)
    assert {r.file_path: len(r.symbols) for r in found.collect()} == {"a.py": 15, "b.py": 1, "c.py": 0, "d.py": 0}
    cards = extraction.module_cards(found, found.select("file_path", F.lit("").alias("responsibility"), F.lit("").alias("layer"), F.array().alias("key_concepts")))
    assert {r.file_path: r.symbol_count for r in cards.collect()} == {"a.py": 21, "b.py": 1, "c.py": 0, "d.py": 0}


def test_compound_names_and_soft_index(spark):
    raw = spark.createDataFrame([("a.py", 0, "read_subjects", "function_name", 1), ("a.py", 1, "requests", "import", 1)], "file_path string, ordinal int, raw_identifier string, identifier_type string, line_number int")
    named = concepts.name_occurrences(raw)
    assert sorted(r.split_name for r in named.collect()) == ["read_subjects", "subjects"]
    assert len({r.occurrence_id for r in named.collect()}) == 2
    assert sorted(r.token for r in concepts.soft_index(raw).collect()) == ["read", "read_subjects", "requests"]


def test_clusters_are_components(spark):
    rng = random.Random(1)
    points = [(g, i, [rng.random(), rng.random()]) for g in "xy" for i in range(25)]
    got = senses.clusters(spark.createDataFrame(points, "name string, id bigint, emb array<double>"), 0.12)
    label = {(r.name, r.id): r.cluster for r in got.collect()}
    for g in "xy":
        mine = {i: p for n, i, p in points if n == g}
        parent = dict(zip(mine, mine, strict=True))

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for i, j in itertools.combinations(mine, 2):
            if sum((a - b) ** 2 for a, b in zip(mine[i], mine[j], strict=True)) ** 0.5 <= 0.12:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        order = {r: k for k, r in enumerate(sorted({root(i) for i in mine}))}
        assert all(label[g, i] == order[root(i)] for i in mine)


def test_names_of_any_size_have_clusters(spark):
    rng = random.Random(7)
    points = [(g, i, [rng.random(), rng.random()]) for g, n in (("x", 90), (None, 70), ("y", 5)) for i in range(n)]
    points += [("x", 200 + i, points[0][2]) for i in range(40)]
    table = spark.createDataFrame(points, "name string, id bigint, emb array<double>")
    told = lambda df: sorted((r.name or "", r.id, r.cluster) for r in df.collect())
    whole = told(senses.clusters(table, 0.09))
    assert len(whole) == len(points) and len({c for _, _, c in whole}) > 5
    assert told(senses.clusters(table, 0.09, most=60)) == whole
    assert told(senses.sense_components(table, 0.09, block=16)) == whole



def test_similar_pairs_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, emb array<double>")
    whole = {(r.i, r.j): round(r.sim, 9) for r in similar_pairs(df, 0.5).collect()}
    parts = {(r.i, r.j): round(r.sim, 9) for r in similar_pairs(df, 0.5, block=16).collect()}
    assert whole == parts and whole


def test_settings(tmp_path):
    file = tmp_path / "s.json"
    file.write_text('{"retrieval": {"top_k": 5, "unknown": 1}}')
    got = load(str(file), environ={"LEXIGRAPH_RETRIEVAL_HOPS": "2"})
    assert (got.retrieval.top_k, got.retrieval.hops, got.relations.min_count) == (5, 2, 3)


def test_sources_cache_and_stream(spark, tmp_path):
    root = tmp_path / "src"
    (root / "pkg" / "tests").mkdir(parents=True)
    (root / "tests").mkdir()
    for p, t in {"pkg/a.py": "class Edition:\n    pass\n", "pkg/tests/b.py": "x = 1\n", "tests/c.py": "y = 1\n", "pkg/n.txt": "no"}.items():
        (root / p).write_text(t)
    assert sorted(r.file_path for r in text_files(spark, str(root)).collect()) == ["pkg/a.py", "tests/c.py"]
    assert json_if_there(spark, str(tmp_path / "none.json"), "a int").count() == 0

    cache = CacheTable(spark, str(tmp_path / "cache"))
    texts = spark.createDataFrame([("p1",), ("p2",)], "text string")
    assert cache.misses(texts).count() == 2
    asked = texts.withColumnRenamed("text", "prompt")
    answers, fresh = models.through_cache(asked, cache.read())
    assert {r.answer for r in answers.collect()} == {"p1", "p2"}
    cache.add(fresh)
    assert cache.misses(texts).count() == 0 and cache.has(texts).count() == 2

    table = str(tmp_path / "occ")
    keep_current(source_stream(spark, str(root)), table, str(tmp_path / "cp")).awaitTermination()
    (root / "pkg" / "a2.py").write_text("class Author:\n    pass\n")
    keep_current(source_stream(spark, str(root)), table, str(tmp_path / "cp")).awaitTermination()
    assert {"edition", "author"} <= {r.split_name for r in current(spark, table).collect()}


def test_command_line(spark, tmp_path):
    from lexigraph.__main__ import main
    from lexigraph.operators.retrieval import explanations
    from lexigraph.queries import SOURCES

    for path, source in SOURCES:
        (tmp_path / "src" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "src" / path).write_text(source)
    out = str(tmp_path / "out")
    main(["build", str(tmp_path / "src"), out], spark)
    assert main(["report", out], spark).columns == ["node", "degree"]
    issues = tmp_path / "issues.json"
    issues.write_text('[{"issue_id": 1, "title": "edition author record merge", "body": "", "changed_files": ["catalog/merge.py"]}]')
    assert main(["evaluate", out, str(issues)], spark).first().n == 1
    ranked = spark.createDataFrame([(1, "f.py", ["b"])], "issue_id int, file_path string, concepts array<string>")
    from lexigraph.operators.graph import walk

    edges = spark.createDataFrame([("a", "c", "synonym", 0.9, None), ("c", "b", "co-occurrence", 0.8, None)], "src string, dst string, type string, weight double, track string")
    reached = walk(spark.createDataFrame([(1, "a", 1.0)], "issue_id int, node string, weight double"), edges, by=("issue_id",))
    seeds = spark.createDataFrame([(1, "a", 1.0)], "issue_id int, concept string, weight double")
    assert explanations(ranked, reached, seeds).first().explanation == "seeds: a\nreached: a ~[syn]~> c ~[cooc]~> b"


def test_elements_bind_what_holds_them():
    from lexigraph.operators.extraction import identifiers

    found = [(r[2], r[3]) for r in identifiers("a.py", "row['k'] = 1\nself.table[0][1] = 2\n(p[0], *q[1:]) = 3\nf()['x'] = 4\n")]
    assert [n for n, kind in found if kind == "variable"] == ["row", "table", "p", "q"]


def test_longest_definition_has_a_full_order(spark):
    from lexigraph.operators.concepts import longest_definition

    rows = [("n", "bb", 1), ("n", "aa", 1), ("n", "c", 0), ("m", "", 3), ("o", "x", 5), ("o", "y", 4)]
    occ = spark.createDataFrame(rows, "split_name string, definition string, ordinal int")
    assert {tuple(r) for r in longest_definition(occ).collect()} == {("n", "aa"), ("o", "y")}


def test_similar_across_is_the_best_of_all(spark):
    rng = random.Random(5)
    left = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(30)] + [(99, None)]
    right = [(f"c{i:02}", [rng.gauss(0, 1) for _ in range(4)]) for i in range(50)]
    right += [("same", right[0][1]), ("zero", [0.0] * 4), (None, right[1][1])]
    rows = lambda data, name: spark.createDataFrame(data, f"{name}, emb array<double>")
    norm = lambda x: sum(v * v for v in x) ** 0.5
    want = {}
    for i, x in left[:-1]:
        sims = [(-round(sum(a * b for a, b in zip(x, y, strict=True)) / (norm(x) * norm(y)), 6), c) for c, y in right if c and any(y)]
        want[i] = sorted(p for p in sims if p[0] <= -0.2)[:5]
    for block in (4096, 8):
        got = similar_across(rows(left, "issue_id int"), rows(right, "concept string"), 0.2, 5, block=block)
        found = {}
        for r in got.collect():
            found.setdefault(r.issue_id, []).append((-r.sim, r.concept))
        assert {i: sorted(p)[:5] for i, p in found.items()} == {i: p for i, p in want.items() if p}
    assert similar_across(rows([], "issue_id int"), rows(right, "concept string"), 0.2, 5).count() == 0


def test_model_answers_paths_and_cards(spark):
    one_text = lambda t: spark.createDataFrame([(t,)], "answer string").select(T.listed_paths(F.col("answer")).alias("p")).first().p
    assert one_text('["a.py", "b/c.py"]') == ["a.py", "b/c.py"]
    assert one_text('so:\n```json\n["a.py"]\n``` or ["b.py"]') == ["a.py"]
    assert one_text('either "a/b.py" or "c.py"') == ["a/b.py", "c.py"]
    assert one_text("none") == [] and one_text(None) == []
    issues = spark.createDataFrame([(1, "it breaks")], "issue_id int, text string")
    prompt = models.ranking_prompts(issues, spark.createDataFrame([("b.py",), ("a.py",)], "file_path string")).first().prompt
    assert "it breaks" in prompt and "a.py\nb.py" in prompt

    said = lambda text: lambda df: df.withColumn("answer", F.lit(text))
    found = spark.createDataFrame([("a.py", ["F"], [])], "file_path string, symbols array<string>, imports array<string>")
    card = models.described(found, said('```json\n{"layer": "core", "key_concepts": ["k"]}\n```')).first()
    assert (card.layer, card.key_concepts, card.responsibility) == ("core", ["k"], "")
    assert models.described(found, said("sorry")).first().layer == "utility"
    told = spark.createDataFrame([(1, "f.py", "seeds: a")], "issue_id int, file_path string, explanation string")
    assert models.told(told, said("short")).first().summary == "short"
    assert models.told(told, said("")).first().summary == "file: f.py\nseeds: a"


def test_reasons_and_consequences(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    cf = spark.createDataFrame([("a", "f1"), ("b", "f2"), ("c", "f3"), ("d", "f4"), ("a", "f3")], "concept string, file string")
    terms = spark.createDataFrame([(1, "A"), (1, "zzz"), (2, "c")], "issue_id int, term string")
    told = models.diagnosed(terms, e, cf)
    why = {(r.issue_id, r.file): r.path for r in models.reasons(told, e, cf).collect()}
    assert why == {(1, "f1"): ["a"], (1, "f2"): ["a", "b"], (1, "f3"): ["a"], (2, "f2"): ["c", "b"], (2, "f3"): ["c"], (2, "f4"): ["c", "d"]}
    hit = {(r.issue_id, r.file): r.direct for r in models.consequences(told, e, cf).collect()}
    assert (1, "f1") not in hit and hit[1, "f4"] is False and hit[2, "f1"] is True


def test_impact_leaves_out_paths_that_hold_one_another(spark):
    e = spark.createDataFrame([("a", "b")], "src string, dst string")
    cf = spark.createDataFrame([("a", "x.py"), ("b", "pkg/x.py"), ("b", "y.py"), ("a", "lib/x.py")], "concept string, file string")
    got = {r.file: r.direct for r in graph.impact(spark.createDataFrame([("x.py",)], "changed string"), e, cf).collect()}
    assert got == {"y.py": False, "lib/x.py": True}


def test_sinks(spark, tmp_path):
    import json
    import xml.etree.ElementTree as ET

    from lexigraph.sources.sinks import save_gexf, save_json, to_graph_database

    tables = {
        "concepts": spark.createDataFrame([('a<&">', 2, ["A"]), ("b", 1, ["B", "b"])], "canonical_name string, frequency bigint, all_raw_identifiers array<string>"),
        "occurrences": spark.createDataFrame([], "occurrence_id string, split_name string"),
        "edges": spark.createDataFrame([("b", 'a<&">', "co-occurrence", 0.2), ('a<&">', "b", "synonym", 0.9)], "src string, dst string, type string, weight double"),
    }
    save_json(tables, f"file://{tmp_path}/g.json")
    doc = json.loads((tmp_path / "g.json").read_text())
    assert (len(doc["concepts"]), doc["occurrences"], len(doc["relationships"])) == (2, [], 2)
    save_gexf(tables, f"file://{tmp_path}/g.gexf")
    root, ns = ET.parse(tmp_path / "g.gexf").getroot(), "{http://gexf.net/1.3}"
    assert {n.get("id") for n in root.iter(f"{ns}node")} == {'a<&">', "b"}
    assert [(x.get("weight"), x.find(f"{ns}attvalues/{ns}attvalue").get("value")) for x in root.iter(f"{ns}edge")] == [("0.2", "co-occurrence")]
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["g.gexf", "g.json"]

    log = tmp_path / "log.txt"

    class Server:
        def run(self, statement, rows):
            if "INDEX" in statement:
                raise ValueError("unknown")
            with open(log, "a") as f:
                f.write(f"{statement} {len(rows)}\n")
            return 7

        def close(self):
            pass

    full = tables["edges"].selectExpr("*", "null as track", "null as reason", "null as subdomain")
    assert to_graph_database(tables | {"edges": full.selectExpr("src", "dst", "type", "weight", "string(track)", "string(reason)", "string(subdomain)")}, Server, clear=True) == {"nodes": 7, "edges": 7}
    lines = log.read_text().splitlines()
    assert lines[0].startswith("MATCH (n) DETACH DELETE") and "CONSTRAINT" in lines[1] and sum(int(x.split()[-1]) for x in lines) == 4


def _serve(replies):
    """A local server that answers by path; a list of replies is used up in turn."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            size = int(self.headers.get("Content-Length") or 0)
            body = json.loads(self.rfile.read(size)) if size else None
            reply = replies(self.path, body)
            code, data = reply if isinstance(reply, tuple) else (200, reply)
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(data).encode())

        do_POST = do_GET

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server, f"http://127.0.0.1:{server.server_port}"


def test_model_clients():
    import pytest

    from lexigraph.sources.clients import ChatWriter, HttpEmbedder, LocalEmbedder, MessagesWriter

    busy = [(429, {})]

    def replies(path, body):
        if busy:
            return busy.pop()
        if path == "/refused/chat/completions":
            return 401, {}
        if path == "/chat/completions":
            return {"choices": [{"message": {"content": body["messages"][-1]["content"].upper()}}]}
        if path == "/messages":
            return {"content": [{"type": "text", "text": "m:"}, {"type": "text", "text": body["messages"][0]["content"]}]}
        return {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}

    server, url = _serve(replies)
    try:
        assert ChatWriter(url, "m", wait=0.01, at_once=1).answer(["a", "b"]) == ["A", "B"]
        assert ChatWriter(f"{url}/refused", "m").answer(["a"]) == [""]
        assert MessagesWriter(url, "m").answer(["x"]) == ["m:x"]
        assert HttpEmbedder(url, "m").embed(["a" * n for n in range(150)]) == [[float(n)] for n in range(150)]
    finally:
        server.shutdown()
    with pytest.raises(RuntimeError):
        LocalEmbedder("none").embed(["a"])


def test_fixing_changes_of_a_tracker(spark):
    from urllib.parse import urlparse

    from lexigraph.sources.issues import fixing_changes

    def replies(path, body):
        return {
            "/issues": [{"number": 1, "state": "closed"}, {"number": 2, "state": "closed"}, {"number": 9, "state": "closed", "pull_request": {}}],
            "/issues/1/timeline": [{"event": "closed"}, {"event": "cross-referenced", "source": {"issue": {"number": 8, "pull_request": {}}}}, {"event": "cross-referenced", "source": {"issue": {"number": 7, "pull_request": {}}}}],
            "/issues/2/timeline": [{"event": "cross-referenced", "source": {"issue": {"number": 5}}}],
            "/pulls/8": {"merged": False},
            "/pulls/7": {"merged": True},
            "/pulls/7/files": [{"filename": "src/a.py"}, {"filename": "src/a.js"}, {"filename": "doc/b.py"}],
        }.get(urlparse(path).path, (404, {}))

    server, url = _serve(replies)
    try:
        assert [tuple(r) for r in fixing_changes(spark, url, 1, "src/").collect()] == [(1, 7, ["src/a.py"])]
    finally:
        server.shutdown()


def test_build_goes_on_caches_and_chooses_senses(spark, tmp_path):
    from lexigraph.plans import localize as L
    from lexigraph.plans.build import build
    from lexigraph.plans.stages import Stages
    from lexigraph.queries import SOURCES

    class Counting(models.TemplateWriter):
        def answer(self, prompts):
            with open(tmp_path / "asked", "a") as f:
                f.write("x\n" * len(prompts))
            return super().answer(prompts)

    files = spark.createDataFrame(SOURCES, "file_path string, text string")
    asked = lambda: (tmp_path / "asked").read_text().count("x") if (tmp_path / "asked").exists() else 0
    edges = lambda t: sorted(map(str, t["edges"].collect()))
    out, cache = f"file://{tmp_path}/out", f"file://{tmp_path}/cache"
    first = build(files, keep=Stages(spark, out), cache=cache, writer=Counting)
    n, told = asked(), edges(first)
    assert n > 0 and told
    first = build(files, keep=Stages(spark, out, 5), cache=cache, writer=Counting)
    assert edges(first) == told and asked() == n
    few = build(files, cache=cache, sample=(2, 1))["occurrences"].where("definition is not null")
    assert 0 < few.count() and few.groupBy("split_name").count().where("count > 1").isEmpty()

    issues = spark.createDataFrame([(1, "edition author record merge", "")], "issue_id bigint, title string, body string")
    assert {r.reason for r in L.seeded(L.issue_texts(issues), first, make=None)[0].collect()} == {"name"}
    assert L.localize(issues, first, make=None).count() > 0
    sense = spark.createDataFrame([("n", [(0, "paper record", ["o1"], 0.0), (1, "gold medal", ["o2", "o3"], 0.0)])], "canonical_name string, definition_clusters array<struct<cluster: int, canonical_definition: string, occurrence_ids: array<string>, distinctiveness: double>>")
    vectors = models.embedded(spark.createDataFrame([(1, "a gold medal"), (2, "paper")], "issue_id bigint, text string"))
    seeds = spark.createDataFrame([(1, "n", 1.0), (2, "n", 1.0), (2, "other", 1.0)], "issue_id bigint, concept string, weight double")
    assert sorted(tuple(r) for r in L.chosen_occurrences(seeds, vectors, sense).collect()) == [(1, "n", "o2"), (1, "n", "o3"), (2, "n", "o1")]
    text = concepts.seed_text(sense.selectExpr("*", "'long definition' as definition", "array('n') as split_terms", "array('N', 'n') as all_raw_identifiers"))
    assert text.first().text == "n | paper record | n | N, n"


def test_yaml_cards_logging_and_report(spark, tmp_path):
    import pytest

    from lexigraph import log
    from lexigraph.operators import reports
    from lexigraph.plans.config import embedder, writer
    from lexigraph.sources.files import cards_if_there

    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("retrieval:\n  top_k: 7\nmodels:\n  embedder: none\n")
    got = load(str(tmp_path / "s.yaml"), environ={"LEXIGRAPH_MODELS_WRITER": "chat", "LEXIGRAPH_MODELS_WRITER_URL": "http://x"})
    assert got.retrieval.top_k == 7 and embedder(got) is None and writer(got)().url == "http://x"
    (tmp_path / "c.json").write_text('{"cards": [{"file_path": "a.py", "key_concepts": ["K"]}, {"file_path": "b.py", "layer": "core"}]}')
    assert sorted((r.file_path, r.layer, r.key_concepts) for r in cards_if_there(spark, str(tmp_path / "c.json")).collect()) == [("a.py", "utility", ["K"]), ("b.py", "core", [])]
    assert cards_if_there(spark, str(tmp_path / "no.json")).count() == 0
    log.setup("INFO", str(tmp_path / "logs" / "l.txt")).info("hello")
    assert "INFO lexigraph: hello" in (tmp_path / "logs" / "l.txt").read_text()
    rows = spark.createDataFrame([(n, ["a.py"], None, None) for n in range(40)], "issue_id int, gt_files array<string>, predicted_files array<string>, file_rank int")
    text = reports.navigation(spark.createDataFrame([(40, 0.5)], "n int, hit_rate double"), rows)
    assert "| hit_rate | 0.5 |" in text and "(40 in all)" in text and "| 30 | 29 | a.py | (none) | - |" in text


def test_paths_lose_their_roots_before_they_meet(spark):
    told = spark.createDataFrame([(1, "src/lib/a.py", 2)], "issue_id int, file_path string, rank int")
    truth = spark.createDataFrame([(1, "lib/a.py")], "issue_id int, file_path string")
    assert evaluation.first_hits(told, truth).first()["rank"] is None
    assert evaluation.first_hits(told, truth, roots=("lib",)).first()["rank"] == 2


def test_architecture_boost_rounds_ties_up(spark):
    """8.321 * 1.05 is 8.73705, which SQL rounds to 8.7371; three steps are 0.15 and four or more 0.20."""
    names = ["alpha", "beta", "gamma", "delta", "omega"]
    scores = {1: 8.321, 2: 8.321, 3: 8.793, 4: 1.0, 5: 1.0}
    ranked = spark.createDataFrame([(7, f"p/f{n}.py", v, 1) for n, v in scores.items()], "issue_id int, file_path string, score double, rank int")
    cards = spark.createDataFrame([(f"p/f{n}.py", names[: n % 6]) for n in (1, 3, 4, 5)], "file_path string, key_concepts array<string>")
    issues = spark.createDataFrame([(7, " ".join(names))], "issue_id int, text string")
    got = {r.file_path: r.score for r in retrieval.architecture_boost(ranked, cards, issues).collect()}
    # 8.793 * 1.15 is 10.11195
    assert got == {"p/f1.py": 8.7371, "p/f2.py": 8.321, "p/f3.py": duckdb.connect().execute("SELECT round(8.793::DOUBLE * 1.15, 4)").fetchone()[0], "p/f4.py": 1.2, "p/f5.py": 1.2}


def counting(monkeypatch, module):
    """Rows of each table that ``module`` cuts from its plan."""
    rows, plain = [], module.cut

    def cut(df, *a):
        rows.append((out := plain(df, *a)).count())
        return out

    monkeypatch.setattr(module, "cut", cut)
    return rows


def test_issues_of_the_same_weights_are_ranked_once(spark, monkeypatch):
    rng = random.Random(5)
    occ = [(f"o{i}", rng.choice("abcdef"), f"p/{rng.randrange(12)}.py", rng.choice(["f", "g", "h", None])) for i in range(300)]
    weights = [(i, c, w) for i in range(90) for c, w in [[("a", 1.0), ("b", 0.5)], [("a", 1.0), ("c", 0.5)], [("d", 0.2)]][i % 3]]
    occ = spark.createDataFrame(occ, "occurrence_id string, split_name string, file_path string, function_name string")
    rank = lambda rows, **more: {(r.issue_id, r["rank"], r.file_path, r.score, r.n_concepts, tuple(r.concepts), tuple((f.name, f.score) for f in r.top_functions)) for r in retrieval.file_scores(spark.createDataFrame(rows, "issue_id int, concept string, weight double"), occ, 12, 5, **more).collect()}
    alone = {(i, *r[1:]) for k in range(3) for r in rank([w for w in weights if w[0] == k]) for i in range(k, 90, 3)}
    made = counting(monkeypatch, retrieval)
    assert rank(weights) == alone and len(alone) == 90 * 5
    assert max(made) <= 3 * 5 * 2 * 4  # classes, files, concepts, functions; not issues
    listed = occ.where("split_name = 'a' and occurrence_id like '%1'").select(F.col("split_name").alias("concept"), F.lit(1).alias("sense"), "occurrence_id")
    chosen = spark.createDataFrame([(i, "a", 1) for i in range(90) if i % 3 == 0], "issue_id int, concept string, sense int")
    by_sense, by_id = rank(weights, locked=chosen, senses=listed), rank(weights, locked=chosen.join(listed, ["concept", "sense"]).drop("sense"))
    assert by_sense == by_id and by_sense != alone and {r for r in by_sense if r[0] % 3} == {r for r in alone if r[0] % 3}


def test_skeletons_are_made_once_for_a_file_and_its_concepts(spark, monkeypatch):
    occ = spark.createDataFrame([("p/a.py", "f", "x", "xx", 1), ("p/a.py", "f", "y", "yyy", 2), ("p/a.py", "g", "x", "x", 3), ("p/b.py", "f", "x", "b", 4)], "file_path string, function_name string, split_name string, code_snippet string, ordinal int")
    ranked = spark.createDataFrame([(i, "p/a.py", ["x", "y"] if i % 2 else ["x"]) for i in range(40)] + [(40, "p/b.py", ["x"])], "issue_id int, file_path string, concepts array<string>")
    made = counting(monkeypatch, retrieval)
    got = {r.issue_id: r.skeleton for r in retrieval.skeletons(ranked, occ).collect()}
    assert len(got) == 41 and got[1] == got[2] == "# f\nyyy\n\n# g\nx" and got[40] == "# f\nb"
    assert made == [3]


def test_soft_ranking_of_issues_with_the_same_orphans(spark, monkeypatch):
    soft = spark.createDataFrame([(t, f"p/{i}.py") for i in range(30) for t in ("alpha", "beta", "gamma") if i % (2 + len(t)) == 0], "token string, file_path string")
    issues = spark.createDataFrame([(i, ["alpha beta", "beta alpha alpha", "gamma named", "nothing"][i % 4]) for i in range(40)], "issue_id int, text string")
    names = spark.createDataFrame([("named",)], "canonical_name string")
    orphans = retrieval.orphan_tokens(issues, soft, names)
    plain = {tuple(r) for r in retrieval.soft_only(orphans, soft, 30, 4).select("issue_id", "rank", "file_path", "score").collect()}
    made = counting(monkeypatch, ranking)
    assert {tuple(r) for r in retrieval.soft_ranking(issues, soft, names, 30, 4).select("issue_id", "rank", "file_path", "score").collect()} == plain and len(plain) == 30 * 4
    assert made == [30]
    few = spark.createDataFrame([(0, "p/7.py"), (1, "p/6.py"), (2, "p/8.py")], "issue_id int, file_path string")
    assert {tuple(r) for r in retrieval.orphan_tokens(issues, soft, names, among=few).collect()} == {tuple(r) for r in orphans.join(few, ["issue_id", "file_path"]).select("issue_id", "token", "file_path").collect()}


def test_paths_to_few_targets_past_a_hub(spark, monkeypatch):
    e = spark.createDataFrame([(f"s{i:03}", "hub") for i in range(200)] + [("hub", "t"), ("s007", "u"), ("u", "v"), ("s003", "u")], "src string, dst string")
    pairs = spark.createDataFrame([(f"s{i:03}", t) for i in range(200) for t in ("t", "u")], "source string, target string")
    made = counting(monkeypatch, graph)
    got = {(r.source, r.target): (r.hops, r.path) for r in graph.shortest_paths(pairs, e).collect()}
    assert max(made) <= 2 * 205  # not the pairs of what a hub is next to
    assert len(got) == 400 and got["s000", "t"] == (2, ["s000", "hub", "t"]) and got["s000", "u"] == (3, ["s000", "hub", "s003", "u"])
    for s, t in (("s007", "u"), ("s003", "t"), ("s150", "u")):
        one = graph.shortest_path(e, s, t).first()
        assert got[s, t] == (one.hops, one.path)


def test_sources_are_dealt_before_they_are_parsed(spark):
    files = spark.createDataFrame([(f"p/{i}.py", f"x{i} = 1\n") for i in range(40)], "file_path string, text string").coalesce(1)
    for found in (extraction.occurrences(files), extraction.symbols(files), extraction.unparsable(files)):
        assert found.rdd.getNumPartitions() > 4
    assert {r.raw_identifier for r in extraction.occurrences(files).collect()} == {f"x{i}" for i in range(40)}


def test_module_cards_parse_each_source_once(spark):
    from lexigraph.queries import queries

    assert "MapInArrow" not in queries()["module_cards"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_diagnosis_weighs_the_same_terms_once(spark, monkeypatch):
    e = spark.createDataFrame([("a", f"n{i}") for i in range(9)], "src string, dst string")
    cf = spark.createDataFrame([("a", "1"), ("b", "2"), *[(f"n{i}", str(i)) for i in range(9)]], "concept string, file string")
    terms = spark.createDataFrame([(i, t) for i in range(60) for t in ("A", f"other{i}", *("b" * (i % 2)))], "issue_id int, term string")
    made = counting(monkeypatch, models)
    got = models.diagnosed(terms, e, cf)
    files = {}
    for r in got["files"].collect():
        files.setdefault(r.issue_id, []).append((r["rank"], r.file, r.score))
    assert len(files) == 60 and all(sorted(files[i]) == sorted(files[i % 2]) for i in files) and files[0] != files[1]
    assert got["weights"].count() == 60 * 10 + 30 and got["unknown"].count() == 60
    assert made[-1] == 10 + 11  # two classes: the term and its neighbours, and one term more


def test_answers_are_never_broadcast(spark):
    asked = spark.createDataFrame([(i, f"what is {i}") for i in range(50)], "id int, prompt string")
    out, _ = models.through_cache(asked, spark.createDataFrame([], "key string, answer string"))
    assert {(r.id, r.answer) for r in out.collect()} == {(i, f"what is {i}") for i in range(50)}
    # the plan as it ran: an empty cache leaves only the new answers, whose estimate is far too small
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()


def test_bm25_of_batches_is_bm25_of_joins(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(["aa", "Bb", "cc_dd", "dd", "x9", "é1a", "_", "ee"]) for _ in range(n))
    docs = spark.createDataFrame([(i, say(rng.randrange(30)) if i % 7 else None) for i in range(200)] + [(900, "aa aa"), (901, "aa aa")], "doc_id int, text string").repartition(5)
    queries = spark.createDataFrame([(1, "aa aa bb"), (2, "cc_dd x9"), (3, "nowhere"), (4, ""), (5, "ee dd")], "item_id int, text string")
    scored = bm25.scores(docs, queries).withColumn("score", F.round("score", 6))
    plain = {tuple(r) for r in ranking.top(scored, ["item_id"], [F.desc("score"), "doc_id"], 10).select("item_id", "rank", "doc_id", "score").collect()}
    made = counting(monkeypatch, bm25)
    assert {tuple(r) for r in bm25.topk(docs, queries).collect()} == plain and len(plain) == 30
    assert made == [7, 202]  # terms asked, documents; no row a document and term
    assert bm25.topk(docs, queries.where("item_id > 2 and item_id < 5")).count() == 0
    for text in ("a1_b2 __ _x 9ab A_B_cc", "", None, "É_é_abc"):
        assert T.code_words(text) == one(spark, text, T.code_tokens)


def test_passages_are_looked_up_without_a_join(spark, monkeypatch):
    passages = spark.createDataFrame([(i, f"a b{i} c d e f") for i in range(30)] + [(99, "tiny")], "item_id int, text string")
    docs = spark.createDataFrame([(1, "za b3 c d e fx, a b4 c d e g"), (2, "a tiny one"), (3, None)], "doc_id int, text string")
    monkeypatch.setattr(evaluation, "PASSAGES", 7)
    found = evaluation.holding(docs, passages)
    assert sorted(map(tuple, found.collect())) == [(3, 1), (99, 2)]
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert evaluation.holding(docs, passages.limit(0)).count() == 0


def test_best_of_blocks_are_the_best_of_all_with_ties(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 1)
    x[200:260] = x[0]  # copies: ties at every rank
    x[299] = np.nan
    ids = [i * 3 % 300 // 3 * 3 + i % 3 for i in range(300)]
    ids[5] = ids[4]  # an id held twice is no pair
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.floor((unit @ unit.T) * 1e6 + 0.5) / 1e6
    best = lambda i, ok: sorted((-cos[i, j], ids[j]) for j in range(300) if cos[i, j] >= 0.3 and ok(ids[i], ids[j]))[:4]
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in zip(ids, x, strict=True)], "id bigint, emb array<double>")
    single = [i for i in range(300) if i not in (4, 5)]
    for block in (None, 40):
        got = ranking.top(similar_pairs(df, 0.3, block=block, k=4), ["i"], [F.desc("sim"), "j"], 4).collect()
        across = ranking.top(similar_across(df.withColumnRenamed("id", "issue_id"), df.withColumnRenamed("id", "concept"), 0.3, 4, block=block), ["issue_id"], [F.desc("sim"), "concept"], 4).collect()
        for rows, ok in (([(r.i, r.sim, r.j) for r in got], lambda a, b: a < b), ([(r.issue_id, r.sim, r.concept) for r in across], lambda a, b: True)):
            told = {}
            for i, sim, j in rows:
                told.setdefault(i, []).append((-sim, j))
            for i in single:
                assert sorted(told.get(ids[i], [])) == best(i, ok), (block, i)


def test_vectors_are_not_sent_to_a_block_for_every_few_thousand_rows():
    from lexigraph.functions.vectors import _side

    assert [_side(n, None) for n in (0, 1000, 2048, 50_000, 600_000)] == [1, 1, 2, 8, 19]
