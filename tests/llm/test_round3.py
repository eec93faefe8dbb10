"""Spelling variants, whitening and exact duplicates against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyhouse.llm import exact_dedup, spelling, whitening
from tallyhouse.llm.catalog import queries
from tallyhouse.llm.common import table

SF = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1


# -- 13 exact duplicates

def brute_dedup(rows):
    groups = defaultdict(list)
    for i, (doc, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), doc is None, doc or 0, i))
    out = Counter()
    for norm, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for m in members:
            out[(None if m[1] else m[2], keep, len(members), m == best, hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out


def as_counter(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def dedup_rows():
    long = "abc def\n" * 30_000
    rows = [(1, "a b c"), (2, "abc"), (3, " a  b  c "), (4, "abd"), (5, None), (6, ""), (7, " \t\r\n\x0b\x0c"), (None, "abc"), (None, "alone"),
            (None, None), (8, "alone"), (8, "alone"), (BIG, "x y"), (BIG + 1, "x y"), (BIG + 2, "xy"), (9, long), (10, long.replace("\n", "")),
            (11, long + "!"), (12, "\U0001F600 \U0001F600"), (13, "\U0001F600\U0001F600"), (14, "Abc")]
    return rows + [(100 + i, "hot text " + " " * (i % 3)) for i in range(400)]


def test_dedup_equals_brute_force(spark):
    rows = dedup_rows()
    docs = spark.createDataFrame([(i, t, "c", 1, "d") for i, t in rows], "doc_id long, text string, content string, id int, digest string").repartition(7)
    assert as_counter(exact_dedup.resolve(docs)) == brute_dedup(rows)


def test_dedup_compares_contents_at_every_stage(spark):
    """With a digest of three values, tiny local memory and few salts nothing but the contents can tell texts apart."""
    rows = [(i, f"text {i % 37}" + " " * (i % 5)) for i in range(500)] + dedup_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    weak = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(3)).cast("string")
    got = exact_dedup.resolve(docs, digest=weak, local_bytes=1, salts=2, filter_bits=17)
    drop = lambda c: Counter((r[:4] for r in c.elements()))
    assert drop(as_counter(got)) == drop(brute_dedup(rows))


def test_dedup_keeps_rows_whole(spark):
    rows = [(BIG, "a b", "x", 1), (BIG + 1, "a  b", "y", 2), (None, None, None, None), (3, "c", "z", 3), (3, "c", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, local string, `row` int")
    got = exact_dedup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[1], rows[2], rows[3]], key=str)


def test_dedup_of_an_empty_table(spark):
    assert exact_dedup.resolve(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_dedup_query_is_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert as_counter(queries()["op13_exact_dedup"](spark, SF)) == brute_dedup(rows)


# -- 11 spelling variants

def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute_counts(rows, low=5, times=3):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= low and n >= times}


def brute_group(n):
    by_gap = defaultdict(set)               # every word under each of its deletions: a plain way to find near words
    for w in n:
        by_gap[w].add(w)
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1:]].add(w)
    near = defaultdict(set)
    for ws in by_gap.values():
        for a in ws:
            near[a] |= {b for b in ws if one_edit(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {(w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def as_set(df):
    rows = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spelling_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = brute_group(brute_counts(rows))
    assert len(want) > 1000 and any(r[1] for r in want)
    assert as_set(queries()["op11_spelling_variants"](spark, SF)) == want


def test_spelling_of_odd_rows(spark):
    rows = [(BIG, "Straße straße STRASSE Straßen straßen straßen straßen straßen straßen"), (None, "Éclair éclair Éclair éclair éclairs " * 4),
            (2, None), (3, ""), (4, "12 + 34"), (5, "colour color " * 9 + "colouur " * 3), (5, "colour color " * 9), (6, "x" * 50_000 + " "),
            (6, "x" * 50_000), (7, "x" * 50_000 + " " + ("x" * 49_999 + " ") * 7), (8, "aabbb aaabbb abbb aabb " * 5)]
    docs = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int")
    assert as_set(spelling.variants(docs)) == brute_group(brute_counts(rows))
    assert spelling.variants(docs.where("false")).count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words=st.dictionaries(st.text("abé", min_size=5, max_size=9), st.integers(3, 60), min_size=2, max_size=120), pieces=st.sampled_from([2, 4, 8]))
def test_spelling_groups_are_brute_force_for_any_words(spark, words, pieces):
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert as_set(spelling.group(df, pieces)) == brute_group(words)


def test_spelling_follows_a_long_chain(spark):
    words = {"a" * (40 - i) + "b" * i + "ccccc": 3 * 2 ** i for i in range(40)}
    assert as_set(spelling.group(spark.createDataFrame(list(words.items()), "word string, n long"))) == brute_group(words)


def test_spelling_candidates_grow_with_the_words(spark):
    """Common endings and beginnings make no candidates: every meeting of a key is nearly a pair."""
    words = [("".join(w) + "ingen", 3) for w in __import__("itertools").product("abcdefgh", repeat=4)]
    df = spark.createDataFrame(words, "word string, n long")
    length = F.char_length("word").cast("int")
    keys = df.select(F.explode(spelling._keys(F.col("word"), length, 0, 8)).alias("key")).groupBy("key").count()
    assert keys.agg(F.max("count")).first()[0] <= 64


# -- 12 whitening

def brute_whiten(rows, count=4):
    rows = [(i, x) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)]
    if not any(x for _, x in rows):
        return {}
    dims = max(len(x) for _, x in rows)
    xs = [[int(np.floor(256 * float(c))) for c in x] + [0] * (dims - len(x)) for _, x in rows]
    fit = np.array(sorted(set(map(tuple, xs))), dtype=np.float64).reshape(-1, dims)
    n, S = len(fit), [sum(int(v) for v in c) for c in fit.T]
    mean = np.array(S) / n
    values, vectors = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-values)
    order = [i for i in order[:count] if values[i] > 1e-9 * max(values.sum(), 1e-300)]
    dev = [sum((n * int(v) - s) ** 2 for v, s in zip(x, S)) for x in xs]
    white = (np.array(xs, dtype=float).reshape(-1, dims) - mean) @ vectors[:, order] / np.sqrt(values[order])
    return {"n": n, "dev": dev, "white": white, "explained": values[order] / values.sum(), "ids": [i for i, _ in rows]}


def check_whitening(df, rows, count=4):
    want = brute_whiten(rows, count)
    got = defaultdict(list)
    for r in df.collect():
        got[r.component].append(r)
    if not want or not len(want["explained"]):
        assert not got
        return
    assert sorted(got) == list(range(1, len(want["explained"]) + 1))
    for c, rs in got.items():
        assert len(rs) == len(want["ids"]) and {r.n for r in rs} == {want["n"]}
        assert all(abs(r.explained - want["explained"][c - 1]) <= 1e-9 for r in rs) and all(r.identity_error <= 1e-9 for r in rs)
        order = lambda i, d, w: (i is None, i or 0, d if d is not None and d < 1 << 63 else 1 << 63, round(abs(w), 6))
        mine = sorted((order(r.vec_id, r.deviation, r.whitened) + (r.whitened,) for r in rs))
        brute = sorted((order(i, d, w) + (w,) for i, d, w in zip(want["ids"], want["dev"], want["white"][:, c - 1])))
        assert [m[:3] for m in mine] == [b[:3] for b in brute]
        a, b = np.array([m[4] for m in mine]), np.array([x[4] for x in brute])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) <= 1e-8 * max(1.0, np.abs(b).max())


def test_whitening_query_equals_eigenvectors(spark):
    rows = [(r.vec_id, r.embedding) for r in table(spark, SF, "embeddings").collect()]
    check_whitening(queries()["op12_whitening"](spark, SF), rows)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(c) for c in rng.normal(size=6) * [5, 3, 2, 1, .5, .2]]) for i in range(60)]
    rows += [(BIG, rows[0][1]), (BIG + 1, rows[0][1]), (None, rows[1][1]), (5, rows[2][1]), (70, None), (71, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (72, [float("nan")] * 6), (73, [float("inf")] + [0.0] * 5), (74, [1.5, -0.0, 0.25]), (75, []), (76, [-0.0] * 6)]
    df = spark.createDataFrame([(i, x, 1, "u") for i, x in rows], "vec_id long, embedding array<double>, x int, id string")
    check_whitening(whitening.whiten(df), rows)
    check_whitening(whitening.whiten(df.repartition(9), count=2), rows, 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [0.0, 1.0]), (2, [1.0, 2.0])],
                                  [(1, []), (2, [])], [(1, [1.0]), (2, [3.0]), (3, [5.0])]])
def test_whitening_of_few_rows(spark, rows):
    check_whitening(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), rows)


def test_whitening_finds_every_one_of_repeated_values(spark):
    """Vectors on the axes, two directions equally long: one start vector sees one of them only, the restart the other."""
    rows = [(10 * d + s, [float(s * k if d == e else 0) for e in range(5)]) for d, k in enumerate([8, 8, 4, 2, 1]) for s in (-1, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    share = {r.component: r.explained for r in got}
    total = 2 * (64 + 64 + 16 + 4 + 1)
    assert [round(share[c] * total, 6) for c in (1, 2, 3, 4)] == [128, 128, 32, 8]
    assert max(r.identity_error for r in got) < 1e-9


def test_whitening_of_huge_entries(spark):
    rows = [(i, [1e15 * i, float(i % 3), -1e15 * (i % 5)]) for i in range(20)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 20 * 3 or len(got) == 20 * 2
    assert all(r.deviation is None for r in got if r.vec_id in (0, 19)) and max(r.identity_error for r in got) < 1e-4


# -- 64-bit ids, clashing columns and large values in the earlier operators

from tallyhouse.llm import ann, html_main, licenses, ngram_join, packing, pieces, pii, toxicity  # noqa: E402
from tallyhouse.llm.catalog import tokenizer_path  # noqa: E402

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def big_docs(spark):
    rows = [(BIG, "alpha beta gamma delta epsilon zeta eta theta"), (BIG + 1, " ".join(WORDS)), (None, "nothing like it here, just words of its own kind"),
            (BIG + 3, None), (7, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


@pytest.mark.parametrize("name", ["toxicity", "pieces", "packing", "join", "fingerprint", "pii"])
def test_large_ids_beside_a_null(spark, name):
    from tallyhouse.llm import fingerprint
    docs, want = big_docs(spark), Counter([BIG, BIG + 1, None, BIG + 3, 7])
    df = {"toxicity": lambda: toxicity.classify(docs, spark.createDataFrame([(BIG, 1), (7, 0)], "doc_id long, toxic int")),
          "pieces": lambda: pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")),
          "packing": lambda: packing.pack(docs, tokenizer_path("byte_bpe_50k.json")),
          "join": lambda: ngram_join.join(docs), "fingerprint": lambda: fingerprint.report(docs), "pii": lambda: pii.report(docs)}[name]()
    got = df.collect()
    assert Counter(r.doc_id for r in got) == want
    if name == "join":
        assert {r.doc_id: r.component_id for r in got if r.doc_id} == {i: i for i in want if i}


def test_large_page_ids_and_license_ids(spark):
    pages = spark.createDataFrame([(BIG, "u", "<html><body><article><p>Hello there</p></article></body></html>"), (None, None, None), (BIG + 1, "v", "")],
                                  "page_id long, url string, html string").coalesce(1)
    assert {r.page_id for r in html_main.extract(pages).collect()} == {BIG, BIG + 1, None}
    name, text = next(iter(licenses.TEMPLATES.items())) if isinstance(licenses.TEMPLATES, dict) else licenses.TEMPLATES[0][:2]
    text = text if isinstance(text, str) else " ".join(text)
    docs = spark.createDataFrame([(BIG, text), (None, text), (BIG + 1, "none")], "doc_id long, text string").coalesce(1)
    assert Counter(r.doc_id for r in licenses.find(docs).collect()) == Counter([BIG, None])


def test_nearest_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(4)
    for scale in (1e20, 1e-30, 1.0):
        x = rng.normal(size=(60, 8)) * scale
        df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = defaultdict(list)
        for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert sorted(got) == [0, 20, 40]
        for q, found in got.items():
            exact = sorted((i for i in range(60) if i != q), key=lambda i: -float(x[i] @ x[q]))[:20]
            assert len(found) == 20 and len(set(found) & set(exact)) >= 18


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline
    names = ["_text_1", "_text_2", "spans", "_n", "_sig", "_toxicity", "row", "_row", "label", "key"]
    texts = [" ".join(WORDS) + f" mail me at a{i}@b.org number {i} " * (i % 3) for i in range(6)] + [None, ""]
    docs = spark.createDataFrame([(BIG + i, t, "en", "s", len(t or ""), *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)],
                                 "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    whole = {r.doc_id: r for r in docs.collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[n] == whole[r.doc_id][n] for n in [*names, "lang", "source"])
            assert r.n_chars == len(r.text or "") or stage is not corpus_pipeline.redact_personal_data


def test_redaction_is_the_same_with_and_without_inlined_patterns(spark, monkeypatch):
    texts = [f"customer {i}{i}{i}-77{i} wrote, ticket 4400{i} open" for i in range(9)] + [f"ticket {i}@mail.org ticket 10.0.0.{i}" for i in range(9)] + [None, "", "ticket 55512 only"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    one = {tuple(r) for r in pii.redact(docs).collect()}
    monkeypatch.setattr(pii, "INLINE_PATTERNS", -1)
    assert one == {tuple(r) for r in pii.redact(docs).collect()}
    assert any("[EMAIL]" in (r[1] or "") for r in one)
