"""Every operator against plain code on small tables, edge cases included."""

import datetime
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import ann_forest, bpe, embedding_dedup, jaccard_join, language_id, mixing, pii, quality, queries, token_counts, url_lists
from lexigraph.llm.common import Scratch, connected_components

DATA = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_tokens int, spans string, score double"


def table(spark, texts, source=None):
    """Documents whose other columns clash with the operators' own names."""
    rows = [(i, t, None, source[k] if source else None, None, 7, "s", None) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


EDGES = [(0, None), (1, ""), (2, " \t\n"), (3, "word"), (4, "a b c d"), (None, "no id here at all"), (5, "twice twice"), (5, "twice twice"), (6, "x" * 5000), (7, "ab " * 4000)]


# ---------------------------------------------------------------- token counts


def greedy(pieces, word):
    n = i = 0
    longest = max(map(len, pieces))
    while i < len(word):
        for j in range(min(len(word), i + longest), i, -1):
            if word[i:j] in pieces:
                n, i = n + 1, j
                break
        else:
            n, i = n + len(word[i].encode()), i + 1
    return n


def test_longest_match_is_greedy():
    rng = random.Random(1)
    for _ in range(400):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        machine = token_counts.LongestMatch(sorted(pieces))
        for _ in range(10):
            word = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 14)))
            assert machine.count(word) == greedy(pieces, word)


def test_token_counts(spark):
    pieces = token_counts.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count_tokens(table(spark, EDGES), pieces).collect()
    known = set(pieces)
    want = Counter()
    for i, t in EDGES:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want[i, len(words), sum(greedy(known, token_counts.MARK + w) for w in words)] += 1
    assert Counter((r.doc_id, r.n_words, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(table(spark, []), pieces).count() == 0


# ---------------------------------------------------------------- neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double")


ODD = [(900, None, 0, 0.0), (901, [0.0] * 8, 0, 0.0), (902, [], 0, 0.0), (903, [1.0, None] * 4, 0, 0.0), (904, [float("nan")] * 8, 0, 0.0), (905, [float("inf")] * 8, 0, 0.0), (906, [1.0, 2.0], 0, 0.0)]


def test_nearest_small_table_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[50] = x[51] = x[0]
    rows = [(i, v.tolist(), 0, 0.0) for i, v in enumerate(x)]
    df = vectors(spark, rows + ODD)
    got = defaultdict(list)
    for r in ann_forest.nearest(df, df.where("vec_id % 10 = 0"), k=4, block=50).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(0, 120, 10))
    for q, found in got.items():
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(120), d)) if i != q][:4]
        assert [(k, i) for k, i, _ in sorted(found)] == list(enumerate(best, 1))
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in found)
    assert ann_forest.nearest(vectors(spark, []), vectors(spark, [])).count() == 0


def recall_of(ids, x, found):
    hits = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits, total = hits + len(found[ids[q]] & set(ids[np.argsort(d, kind="stable")[:10]].tolist())), total + 10
    return hits / total


def test_nearest_recall(spark):
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").collect()
    found = defaultdict(set)
    for r in queries.op2_hash_forest_neighbours(spark, DATA).collect():
        found[r.query_id].add(r.vec_id)
    assert recall_of(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float), found) >= 0.9


def test_nearest_recall_from_few_candidates(spark):
    """8,000 vectors, a third of them near copies of one, in two blocks; outside that group under 5 % are measured."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 48))
    x[:2600] = x[0] + rng.normal(size=(2600, 48)) * 0.1
    x[2600:2900] = x[2600]
    x = np.float32(x[rng.permutation(8000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = defaultdict(set)
    for r in ann_forest.nearest(df, df.where("vec_id % 100 = 0"), block=4000, verified=190).collect():
        found[r.query_id].add(r.vec_id)
    distinct = [q for q in range(0, 8000, 100) if (x == x[q]).all(1).sum() == 1]
    assert recall_of(np.arange(8000), x.astype(float), found) >= 0.9 and len(distinct) > 70
    for q in set(range(0, 8000, 100)) - set(distinct):  # equal vectors: the smallest other ids
        assert found[q] == set([i for i in np.flatnonzero((x == x[q]).all(1)).tolist() if i != q][:10])


def test_nearest_repeated_rows(spark):
    rows = [(5, [1.0, 0.0], 0, 0.0)] * 30 + [(5, [0.0, 1.0], 0, 0.0), (6, [1.0, 0.1], 0, 0.0), (None, [1.0, 0.0], 0, 0.0), (7, [3.0, 0.0], 0, 0.0)]
    df = vectors(spark, rows)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann_forest.nearest(df, df.where("vec_id = 7")).collect()]
    assert sorted(got) == [(7, 1, 5), (7, 2, 6), (7, 3, 5)]


# ---------------------------------------------------------------- components


def smallest(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    for chunk, tasks in ((3, 7), (10**6, 1), (10**6, 5)):
        got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(tasks), Scratch(spark, "test"), chunk=chunk)
        assert {r.node: r.component for r in got.collect()} == smallest([e for e in edges if e[0] != e[1]])
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark, "test")).count() == 0


# ---------------------------------------------------------------- Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def linked(texts):
    sets = [(i, shingles(t)) for i, t in texts]
    edges = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    return {i: len(s) for i, s in sets}, smallest(edges)


def family(rng, size, edits, words=120):
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    for _ in range(size):
        out = list(base)
        for _ in range(rng.randrange(edits)):
            out[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        yield " ".join(out)


def like_texts():
    rng = random.Random(8)
    texts = [t for k in range(6) for t in family(rng, 12, 3 + 2 * k)]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [passage + " " + " ".join(f"z{rng.randrange(900)}" for _ in range(rng.randrange(5, 90))) for _ in range(40)]
    texts += ["Same TEXT with some Words here", "same text with some words here", "É É É É É É", "é é é é é é"]
    return [(i, t) for i, t in enumerate(texts)] + [(i + 1000, t) for i, t in EDGES if i is not None]


@pytest.mark.parametrize("sizes", [{}, {"longest": 3, "part": 4}, {"digest_bits": 5}])
def test_jaccard_join_is_exact(spark, sizes):
    """As it runs; with every list cut and every pair of blocks a group; with digests that clash."""
    rows = like_texts()
    n, component = linked(list(dict(rows).items()))
    got = jaccard_join.components(table(spark, rows), **sizes).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (n[r.doc_id], component.get(r.doc_id, r.doc_id)) for r in got)


def test_jaccard_join_odd_tables(spark):
    rows = like_texts()
    _, component = linked(list(dict(rows).items()))
    unique = list(dict(rows).items())
    kept = jaccard_join.keep_first(table(spark, unique))
    assert kept.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in unique if component.get(i, i) == i)
    assert jaccard_join.components(table(spark, [])).count() == 0 == jaccard_join.keep_first(table(spark, [])).count()
    assert {r.n_shingles for r in jaccard_join.components(table(spark, [(None, None), (1, "")])).collect()} == {0}


def test_jaccard_join_ids_that_repeat(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    near = a + " more"
    rows = [(1, a), (5, near), (5, b), (5, b), (7, b), (None, a), (None, c), (None, c), (8, d), (9, d), (9, d), (9, None), (9, None)]
    got = Counter((r.doc_id, r.component_id) for r in jaccard_join.components(table(spark, rows)).collect())
    assert got == Counter([(1, 1), (5, 1), (5, 5), (5, 5), (7, 5), (None, 1), (None, None), (None, None), (8, 8), (9, 8), (9, 8), (9, 9), (9, 9)])
    kept = Counter((r.doc_id, r.text) for r in jaccard_join.keep_first(table(spark, rows)).collect())
    assert kept == Counter([(1, a), (5, b), (None, c), (8, d), (9, None), (9, None)])


# ---------------------------------------------------------------- vectors' near-duplicates


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(3)
    x = [rng.normal(size=8) for _ in range(80)]
    x += [x[k] + rng.normal(size=8) * 0.12 for k in range(40)] + [x[0]] * 5
    rows = [(i, np.float32(v).tolist(), 0, 0.0) for i, v in enumerate(x)]
    y = np.array([r[1] for r in rows], float)
    y /= np.sqrt((y * y).sum(1, keepdims=True))
    hit = y @ y.T >= 0.95
    component = smallest([(i, j) for i in range(len(y)) for j in range(i) if hit[i, j]])
    for block in (4096, 16):
        old, embedding_dedup.BLOCK = embedding_dedup.BLOCK, block
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(vectors(spark, rows + ODD)).collect()}
        embedding_dedup.BLOCK = old
        for i in range(len(y)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (hit[i].sum() - 1, component.get(i, i), component.get(i, i) == i)
        assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, *_ in ODD)
    assert embedding_dedup.near_duplicates(vectors(spark, [])).count() == 0
    again = [(5, [1.0, 0.0], 0, 0.0)] * 3 + [(5, [0.0, 1.0], 0, 0.0), (6, [1.0, 0.01], 0, 0.0), (None, [1.0, 0.0], 0, 0.0), (8, [-1.0, 0.0], 0, 0.0)]
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(vectors(spark, again)).collect())
    assert got == Counter([(5, 3, 5, True)] * 3 + [(5, 0, 5, True), (6, 3, 5, False), (None, 0, None, False), (8, 0, 8, True)])


# ---------------------------------------------------------------- BPE


def test_bpe_like_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    rng = random.Random(0)
    texts = [(i, "".join(rng.choice("ab 'std\n\t\x1c\x85 é²Ⅷ९　<|endoftext|>😀ñ.!0_") for _ in range(rng.randrange(60)))) for i in range(600)]
    texts += [(i, t) for i, t in EDGES] + [(601, "x<|endoftext|>y <|endoftext|>"), (602, "abcdefgh" * 400), (603, " " * 500 + "x")]
    got = bpe.digests(bpe.encode(table(spark, texts), FILE)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.encode(table(spark, []), FILE).count() == 0


# ---------------------------------------------------------------- PII


def base_spans(text):
    """The base rules as plain expressions."""
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


def test_pii_base_rules():
    rng = random.Random(5)
    bits = ["a@b.co", "x.y%z@", "@", "a@b.c%d@e.f", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+44", "é", " ", "-", ".", "12", "0001.2.3.4", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert [s[:3] for s in pii.spans_of(text) if s[0] in pii.BASE] == base_spans(text), text


def test_pii_context_and_checks(spark):
    text = "pay to IBAN GB82 WEST 1234 5698 7654 32, phone 555-123-4567, ssn 123-45-6789"
    assert [s[0] for s in pii.spans_of(text)] == ["iban", "phone_local", "ssn"]
    assert pii.spans_of("IBAN GB82 WEST 1234 5698 7654 33, order 555-123-4567, 123-45-6789") == []
    rows = [*EDGES, (9, "mail é me@x.org or +1 555 123 4567"), (10, "9" * 20000), (11, "1." * 5000)]
    got = {r.doc_id: r for r in pii.digests(pii.find(table(spark, rows))).collect()}
    assert (got[9].n_email, got[9].n_phone, got[9].spans) == (1, 1, "email:7:15,phone:19:34")
    assert got[0].base_sha256 == hashlib.sha256(b"").hexdigest() and got[0].spans == ""
    clean = pii.redact(table(spark, rows))
    assert clean.columns == table(spark, []).columns
    by_id = {r.doc_id: r for r in clean.collect()}
    assert by_id[9].text == "mail é <EMAIL> or <PHONE>" and by_id[9].n_chars == len(by_id[9].text) and by_id[0].text is None
    assert pii.find(table(spark, [])).count() == 0


# ---------------------------------------------------------------- mixing


def plain_targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, target = 1.5 * sum(sizes.values()), set(sizes), {}
    while open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    return target


def test_mixing(spark):
    rng = random.Random(6)
    names = ["a", "b", "é", None, "z", "B"]
    rows, source = [], []
    for i in range(900):
        rows.append((i, None if i % 97 == 0 else "w " * rng.choice([0, 1, 3, 40, 300])))
        source.append(rng.choice(names[:1] * 6 + names))
    docs = table(spark, rows + [(None, "x y"), (5, "q q q")], source + ["a", "z"])
    got = mixing.mix_documents(docs, fan_in=16).collect()
    assert len(got) == 902
    sizes = defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
    want = plain_targets(sizes)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        largest[r.source] = max(largest[r.source], r.size)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix_documents(docs.repartition(7), fan_in=16).collect()))
    mixed = mixing.repeat(docs, fan_in=16)
    assert mixed.columns == docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in got for _ in range(r.copies))
    assert mixing.mix_documents(table(spark, [])).count() == 0
    assert [r.copies for r in mixing.mix_documents(table(spark, [(1, None)])).collect()] == [0]


def test_mixing_many_repeated_rows(spark):
    """20,000 rows without id and alike, beside others: no group grows, and the copies repeated are those planned."""
    rows = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"))
    rows = rows.unionByName(spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x y").alias("text"), F.lit("t").alias("source"))).repartition(6)
    scratch = Scratch(spark, "mix-test")
    sized = scratch.save(mixing._sized(rows), "sized")
    numbers = mixing._numbered(sized, scratch).where("doc_id is null").select("nth").collect()
    assert sorted(r.nth for r in numbers) == list(range(1, 20_001))
    mixing.mix(sized, scratch).count()
    assert scratch.spark.read.parquet(f"{scratch.root}/mix-1").agg(F.max(F.size("r.done"))).first()[0] < 300
    got = mixing.mix_documents(rows).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.sum("copies").alias("copies")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in got)
    mixed = {r.source: r["count"] for r in mixing.repeat(rows).groupBy("source").count().collect()}
    assert mixed == {r.source: r.copies for r in got}


def test_targets_of_many_sources(spark):
    rng = random.Random(3)
    sizes = {f"h{i}é" if i % 3 else f"H{i}": rng.choice([0, 1, 10, 1000, 90000]) for i in range(300)} | {None: 500, "": 7}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint").repartition(5)
    got = {r.source: r.target for r in mixing.targets(sources, Scratch(spark, "targets")).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


# ---------------------------------------------------------------- quality


def test_quality_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = queries.op10_quality_scores(spark, "/root/testdata/sf0.01").collect()
    judged = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in judged) / len(judged) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def plain_features(text):
    """The features of :func:`quality.features`, by loops over the bytes."""
    data = (text or "").encode()
    n, words = max(1, len(data)), data.split()
    m = max(1, len(words))
    size = [len(w) for w in words] or [0]
    mean = sum(size) / len(size)
    counts = sorted(Counter(words).values(), reverse=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    lower, upper, digit, high = (sum(lo <= c <= hi for c in data) for lo, hi in ((97, 122), (65, 90), (48, 57), (128, 255)))
    mark = [33 <= c < 127 and not chr(c).isalnum() for c in data]
    space = sum(c in (9, 10, 11, 12, 13, 32) for c in data)
    ahead = list(zip(words, words[1:]))
    of = lambda chars: sum(c in chars.encode() for c in data)
    share = [k / n for k in Counter(data).values()]
    return [
        np.log(1 + len(words)), mean, (sum((x - mean) ** 2 for x in size) / len(size)) ** 0.5, sum(x > 20 for x in size) / len(size), sum(x <= 3 for x in size) / len(size),
        len(counts) / m, len(counts) / m * np.log(1 + m), (len(set(ahead)) if ahead else 1) / max(1, len(words) - 1), counts[0] / m if counts else 0.0, sum(counts[:5]) / m, sum(a == b for a, b in ahead) / m,
        upper / max(1, lower + upper + high), digit / n, sum(mark) / n, high / n, space / n,
        sum(a and b for a, b in zip(mark, mark[1:])) / n, sum(a and b and x == y for a, b, x, y in zip(mark, mark[1:], data, data[1:])) / n,
        of("#*%&$!|@<>{}[]_=~^+/\\") / n, of("|") / m, of("!") / m, of(".?") / m, of(",") / m, np.log(1 + len(lines)), 1 - len(set(lines)) / max(1, len(lines)), np.log(1 + n / max(1, len(lines))), -sum(x * np.log(x) for x in share),
    ]


def test_quality_query_like_plain_code(spark):
    """Every score of the query from plain features and the same training rows, fitted again without Spark."""
    import zlib

    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    x = {r.doc_id: plain_features(r.text) for r in docs}
    out = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in docs}
    taught = [i for i in sorted(x) if i in labels and not out[i]]
    model = quality.fit(np.array([x[i] for i in taught]), np.array([labels[i] for i in taught]))
    rows = queries.op10_quality_scores(spark, DATA).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == out[r.doc_id] and r.predicted == (r.score >= 0.5)
        assert abs(r.score - model.score(np.array([x[r.doc_id]]))[0]) < 1e-6


def test_quality_of_repeated_and_conflicting_labels(spark):
    docs = table(spark, [(i, f"w{i % 7} " * (i % 5 + 1)) for i in range(3, 60)] + [(3, "other text"), (4, "x" * 2_000_000), (5, None)])
    rows = [(i, i % 2, 0) for i in range(3, 60)]
    kind = "doc_id bigint, quality int, toxic int"
    once = quality.train(docs, spark.createDataFrame(rows, kind))
    twice = quality.train(docs.repartition(5), spark.createDataFrame(rows * 3, kind).repartition(7))
    assert (once.weights == twice.weights).all() and once.threshold == twice.threshold
    less = quality.train(docs, spark.createDataFrame([r for r in rows if r[0] not in (7, 9)], kind))
    torn = quality.train(docs, spark.createDataFrame(rows + [(7, 0, 0), (9, 0, 0)], kind))
    assert (less.weights == torn.weights).all()
    some = quality.train(docs, spark.createDataFrame(rows, kind), sample=10)
    assert len(some.weights) == len(once.weights) and quality.score(docs, some).count() == docs.count()


def test_quality_edge_cases(spark):
    docs = table(spark, EDGES)
    none = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, 0), (6, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model).count() == len(EDGES)
    assert quality.keep(docs, model).columns == docs.columns
    assert quality.score(table(spark, []), model).count() == 0


def many_labelled(spark, n, bads):
    """``n`` documents of random words and punctuation; those labelled 0 have more of it."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(n):
        bad = bads(i)
        rows.append((i, " ".join(rng.choice(["alpha", "be", "gamma9", "Delta", "!!" if bad else "end."]) for _ in range(rng.randint(3, 9)))))
        labels.append((i, int(not bad), 0))
    return table(spark, rows), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(rows), {i: y for i, y, _ in labels}


def taught_by(texts, labels):
    import zlib

    ids = [i for i in sorted(labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    return np.array([quality.features(texts[i].encode()) for i in ids]), np.array([labels[i] for i in ids])


def test_quality_learns_from_every_labelled_row(spark):
    """Medians, spreads and the threshold are those of all of some 22,000 rows, in several blocks and files."""
    docs, labels, texts, y = many_labelled(spark, 33_000, lambda i: i % 5 == 0)
    x, label = taught_by(texts, y)
    assert len(label) > 20_500
    model = quality.train(docs, labels)
    assert (model.mean == np.median(x, axis=0)).all()
    assert np.allclose(model.spread, np.maximum(x.std(axis=0), 1e-6), rtol=1e-9)
    s = np.sort(model.strength(x))
    k = int((label == 0).sum())
    assert abs(model.threshold - (s[k - 1] + s[k]) / 2) < 1e-9 and abs(model.scale - s.std() / 4) < 1e-9
    same = quality.fit(x, label)  # the same rows on the driver, other partners
    assert np.abs(same.score(x) - model.score(x)).mean() < 0.02
    again = quality.train(docs.repartition(3), labels.repartition(5))
    assert np.allclose(again.weights, model.weights, atol=1e-9) and abs(again.threshold - model.threshold) < 1e-9


def test_quality_with_a_class_that_most_blocks_lack(spark):
    """Three documents of 14,000 are labelled 0: blocks without any draw them from the pool."""
    docs, labels, texts, y = many_labelled(spark, 14_000, lambda i: i in (3, 5000, 9000, 9001))
    x, label = taught_by(texts, y)
    k = int((label == 0).sum())
    assert 0 < k <= 4
    for model in (quality.train(docs, labels, few=0), quality.fit(x, label)):
        s = np.sort(model.strength(x))
        assert np.isfinite(model.weights).all() and abs(model.threshold - (s[k - 1] + s[k]) / 2) < 1e-9
        assert model.strength(x)[label == 0].mean() < model.strength(x)[label == 1].mean() - 1


def test_order_statistics_are_exact():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(999, 3)) * [1, 1e-300, 1e200], [[0.0, -0.0, np.pi]] * 500, rng.integers(-3, 3, (500, 3))])
    cuts = np.array_split(x, 7)
    ranks = np.array([[0, 5, 998], [1000, 1001, 1998]])
    got = quality._ranked(lambda f: sum(f(c, None) for c in cuts), lambda v: v, ranks)
    assert (got == np.take_along_axis(np.sort(x, axis=0), ranks, 0)).all()


# ---------------------------------------------------------------- language


def test_language_of_pages(spark):
    rows = queries.op3_page_language(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url"), "page_id").collect()
    told = [(r.lang, m[1]) for r in rows if (m := re.search(r"://[^/]*/([a-z]{2})/", r.url))]
    assert sum(a == b for a, b in told) / len(told) >= 0.95


def test_language_query_like_plain_code(spark):
    """Every language and confidence of the query, by loops over pages."""
    langs, model = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    pages = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r for r in queries.op3_page_language(spark, DATA).collect()}
    soft = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    rows, sums = [], defaultdict(lambda: np.zeros(len(langs)))
    for r in pages:
        m = re.match(r"[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", (r.url or "").lower())
        host = m[1].rstrip(".") if m else ""
        parts = host.split(".")
        levels = [("all",), ("suffix", parts[-1]), ("domain", ".".join(parts[-2:])), ("host", host)]
        data = language_id.visible(r.html).encode().lower()
        g = [language_id.grams(data[i : i + 3])[0] for i in range(len(data) - 2)]
        ll = model.astype(np.float32)[:, g].sum(1, dtype=np.float64) * language_id.TEMPER * min(1, language_id.TRUST / max(1, len(g)))
        p = soft(ll)
        mark = ("mark", language_id.declared(r.html))
        for level in [*levels, mark]:
            sums[level] += p
        rows.append((r.page_id, levels, mark, ll, p))
    for i, levels, mark, ll, p in rows:
        prior = np.full(len(langs), 1 / len(langs))
        for level in levels:
            less = np.maximum(sums[level] - p, 0)
            prior = (less + language_id.K * prior) / (less.sum() + language_id.K)
        given = (np.maximum(sums[mark] - p, 0) + 0.1) / (sums["all",] + 1)
        post = soft(ll + np.log(prior) + np.log(given))
        assert got[i].declared == mark[1] and abs(got[i].confidence - post.max()) < 1e-6
        assert got[i].lang == langs[int(post.argmax())] or np.sort(post)[-1] - np.sort(post)[-2] < 1e-9


def test_language_edge_cases(spark):
    langs, model = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    pages = [(1, None, None, "x"), (2, "not a url", "", "x"), (3, "http://h.example.fr/", '<html lang="fr">', "x"), (3, "http://h.example.fr/", "<p>les des une que pour avec dans</p>", "x"), (None, "http://h.example.fr/", "<p>" + "les des une " * 100_000, "x")]
    kind = "page_id bigint, url string, html string, lang string"
    got = language_id.identify(spark.createDataFrame(pages, kind), langs, model).collect()
    assert len(got) == 5 and all(r.lang in langs and 0 < r.confidence <= 1 for r in got)
    assert language_id.identify(spark.createDataFrame([], kind), langs, model).count() == 0
    no_langs, nothing = language_id.train(spark.createDataFrame([], "doc_id bigint, text string, lang string"))
    assert [r.lang for r in language_id.identify(spark.createDataFrame(pages, kind), no_langs, nothing).collect()] == [None] * 5


def test_language_declared_anywhere_in_a_page(spark):
    late = "<!-- " + "licence, see <html> " * 400 + '-->\n<HTML class="a"\n xml:lang=FR>'
    assert len(late) > 8000 and language_id.declared(late) == "fr"
    assert language_id.declared(" " * 5000 + '<html lang="de-AT">') == "de"
    assert language_id.declared("<html>" * 5000 + "<p lang='en'>") == "" == language_id.declared(None)
    assert language_id.declared("<html " * 200_000) == ""
    once = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)  # slow, in one piece
    rng = random.Random(5)
    for _ in range(2000):
        page = "".join(rng.choices(["<html", "<HTML", ">", " ", "lang", "=", '"', "en", "x-", "-", "<p", "l"], k=14))
        found = once.search(page)
        assert language_id.declared(page) == (found[1].lower() if found else ""), page
    langs, model = language_id.train(spark.read.parquet(f"{DATA}/documents.parquet"))
    got = language_id.identify(spark.createDataFrame([(1, "http://h.example/", late)], "page_id bigint, url string, html string"), langs, model).first()
    assert got.declared == "fr"


# ---------------------------------------------------------------- URL lists


def test_lists_as_of_the_fetch(spark):
    day = lambda n: datetime.date(2024, 1, n)
    events = [("s", "domain", "Bad.example.com", "add", day(5)), ("s", "domain", "bad.example.com", "add", day(6)), ("s", "domain", "bad.example.com", "remove", day(10)), ("s", "domain", "bad.example.com", "add", day(20)), ("t", "prefix", "x.org/a/b", "add", day(1)), ("u", "host", "x.org", "add", day(15)), (None, "host", "x.org", "add", day(1))]
    entries = spark.createDataFrame(events, "list string, kind string, pattern string, action string, at date")
    urls = [(1, "http://www.bad.example.com/p", day(4)), (2, "http://www.bad.example.com/p", day(5)), (3, "http://bad.example.com:80", day(10)), (4, "https://u@BAD.example.com/?q", day(25)), (5, "http://notbad.example.com/", day(7)), (6, "http://x.org/a/b/c?d", day(15)), (7, "http://x.org/a/bc", day(2)), (8, None, day(7)), (9, "odd", day(7)), (10, "http://x.org/", None), (2, "http://www.bad.example.com/p", day(5))]
    captures = spark.createDataFrame([(*u, "clash") for u in urls], "capture_id bigint, url string, fetched_at date, lists string")
    got = sorted((r.capture_id, r.n_active, r.lists, r.blocked) for r in url_lists.judge(captures, entries).collect())
    hit = {2: "s", 4: "s", 6: "t,u"}
    assert got == sorted((i, len(hit[i].split(",")) if i in hit else 0, hit.get(i, ""), i in hit) for i, *_ in urls)
    assert not any(r.blocked for r in url_lists.judge(captures, entries.limit(0)).collect())
    assert url_lists.judge(captures.limit(0), entries).count() == 0


@pytest.mark.parametrize("few", [url_lists.FEW, 0])
def test_prefixes_in_any_form(spark, few):
    """Few entries, and as many as have to be salted."""
    day = datetime.date(2024, 1, 1)
    patterns = ["x.org", "y.org/", "Z.org//a//b/", "w.org./c"]
    entries = spark.createDataFrame([(p, "prefix", p, "add", day) for p in patterns], "list string, kind string, pattern string, action string, at date")
    urls = ["http://x.org/a/b", "http://x.org", "http://xx.org/", "http://y.org", "http://y.org/q?z", "http://z.org/a/b/c", "http://z.org//a///b", "http://z.org/a/bb", "http://w.org/c/", "http://w.org./c", "http://w.org/", "http://x.org/" + "s/" * 300_000, "http://" + "a." * 100_000 + "x.org/"]
    captures = spark.createDataFrame([(i, u, day) for i, u in enumerate(urls)], "capture_id bigint, url string, fetched_at date")
    got = {r.capture_id: r.lists for r in url_lists.judge(captures, entries, few=few).collect()}
    want = ["x.org", "x.org", "", "y.org/", "y.org/", "Z.org//a//b/", "Z.org//a//b/", "", "w.org./c", "w.org./c", "", "x.org", ""]
    assert [got[i] for i in range(len(urls))] == want


def test_url_query_like_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    got = queries.op4_url_lists_as_of(spark, DATA)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(queries.oracle_sql()["op4_url_lists_as_of"]).fetchall())


# ---------------------------------------------------------------- pipeline


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline

    scratch, out = Scratch(spark, "stages"), []
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        after = scratch.save(f(spark, docs, DATA), f"s{k}")
        out.append((name, docs, after))
        docs = after
    return out


def test_pipeline_stages(stages):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    for name, before, after in stages[:-1]:
        assert after.columns == before.columns, name
    (_, docs, good), (_, _, single), (_, _, clean), (_, _, mixed), (_, _, ids) = stages
    assert 0 < good.count() < docs.count()
    rows = [(r.doc_id, r.text) for r in good.collect()]
    _, component = linked(rows)
    assert {r.doc_id for r in single.collect()} == {i for i, _ in rows if component.get(i, i) == i}
    assert clean.count() == single.count()
    assert all(not pii.spans_of(r.text) for r in clean.where(F.col("text").contains("@")).collect())
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2
    text = {r.doc_id: r.text for r in clean.collect()}
    got = ids.collect()
    assert Counter(r.doc_id for r in got) == copies
    assert all(list(r.ids) == library.encode(text[r.doc_id], add_special_tokens=False).ids for r in got)


def odd_documents(spark):
    """Documents of the smallest table, with nulls in every column, empty and very long texts, repeated rows and ids, and a clashing column."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    good = docs.where("length(text) > 400").limit(1).first()
    odd = [(None, None, None, None, None), (None, good.text, None, None, None), (70_000, "", "en", None, 0), (70_001, None, None, "web", None), (70_002, "word " * 60_000, "en", "web", 300_000), (70_003, "x" * 400_000, None, None, 400_000), (70_004, good.text, "en", "web", None), (70_004, good.text, "en", "web", None), (70_005, good.text + " mail me@example.org now", "en", "web", None), (70_006, " \n\t ", "en", "web", 4)]
    more = spark.createDataFrame(odd, docs.schema)
    return docs.unionByName(more).withColumn("cls", F.lit("clash")).withColumn("row", F.lit(7)), good


def test_pipeline_stages_with_odd_documents(spark, tmp_path):
    import corpus_pipeline

    docs, good = odd_documents(spark)
    scratch = Scratch(spark, "odd")
    docs = scratch.save(docs, "docs")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = scratch.save(stage(spark, docs, DATA), f"s{k}")
        none = stage(spark, docs.limit(0), DATA)
        assert none.count() == 0 and none.columns == after.columns, name
        if name != "encode":
            assert after.columns == docs.columns and after.where("cls <> 'clash' or row <> 7").count() == 0, name
        ids = Counter(r.doc_id for r in after.select("doc_id").collect())
        was = Counter(r.doc_id for r in docs.select("doc_id").collect())
        if name in ("quality", "near_duplicates"):
            assert all(n <= was[i] for i, n in ids.items()), name
        if name == "near_duplicates":  # the same text under the group's smallest id, others and none: one stays
            assert after.where(F.col("text") == good.text).count() == docs.where(F.col("text") == good.text).limit(1).count()
            assert after.where("text is null or trim(text) = ''").count() == docs.where("text is null or trim(text) = ''").count()
        if name == "personal_data":
            assert ids == was and not after.where(F.col("text").contains("me@example.org")).count()
        if name == "mix":
            assert set(ids) <= set(was) and not after.where("text is null or text = ''").count()
        if name == "encode":
            assert ids == was
        docs = after


def test_pipeline_run_is_its_stages(spark, stages):
    import corpus_pipeline

    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == Counter((r.doc_id, tuple(r.ids)) for r in stages[-1][2].collect())


def test_executors_collect_their_garbage(spark):
    from lexigraph.sources.scratch import collect_garbage

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans  # a local session's executor is the driver
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    before = full()
    collect_garbage(spark)
    assert full() > before
