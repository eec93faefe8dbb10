"""The llm operators against brute force, on small fixtures with every defined edge case."""

import hashlib
import html
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyhouse.llm import (ann, chat, fingerprint, html_main, licenses, ngram_join, packing, pieces, pii, toxicity)
from tallyhouse.llm.catalog import tokenizer_path
from tallyhouse.llm.common import table

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, label int"


def docs_of(spark, texts):
    """Documents with clashing extra columns, a null id and a repeated row."""
    rows = [(i, t, None, "s", None if t is None else len(t), "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(corpus):
    return {r.doc_id: r.text for r in corpus.collect()}


# -- 1 toxicity

def toxic_frames(spark):
    rng = np.random.default_rng(0)
    plain = ["river", "bridge", "market", "winter", "garden", "teacher", "music", "window", "letter", "summer"]
    bad = ["gronkful", "gronkish", "gronker"]
    texts, toxic = [], []
    for i in range(240):
        words = list(rng.choice(plain, 30))
        if i % 3 == 0:
            words[5:5] = list(rng.choice(bad, 4))
        texts.append(" ".join(words))
        toxic.append(int(i % 3 == 0))
    docs = docs_of(spark, texts + [None, "", "gronkly " * 5 + " ".join(plain), "river " * 20_000])
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(toxic)] + [(0, None), (5, 0), (5, 0), (None, 1)], "doc_id long, toxic int")
    return docs, labels, toxic


def test_toxicity_finds_unseen_inflections_and_holds_out(spark):
    docs, labels, toxic = toxic_frames(spark)
    got = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    assert len(got) == 244
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i, r in got.items() if r.held_out and i < 240} == set(held)
    right = sum(got[i].predicted == toxic[i] for i in held)
    assert right / len(held) > 0.95
    assert got[242].predicted == 1  # "gronkly" shares its n-grams only
    assert got[240].score == got[241].score < 0.7 and got[243].predicted == 0


def test_toxicity_without_labels_or_rows(spark):
    docs, labels, _ = toxic_frames(spark)
    assert {r.predicted for r in toxicity.classify(docs.limit(3), labels.where("false")).collect()} == {0}
    assert toxicity.classify(docs.where("false"), labels).count() == 0


def test_toxicity_score_is_the_mean_of_words(spark):
    table_, bias = np.random.default_rng(1).normal(size=1 << 10), 0.3
    scorer = toxicity.Scorer(table_, bias)
    text = "One word, another word"
    words = ["one", "word", "another", "word"]
    b, w = toxicity.subwords(words, 1 << 10)
    z = np.mean([table_[b[w == i]].mean() for i in range(4)]) + bias
    assert scorer([text])[0] == pytest.approx(1 / (1 + np.exp(-z)))


# -- 2 pieces

def test_pieces_equal_the_library(spark, corpus):
    from sentencepiece import SentencePieceProcessor
    path = tokenizer_path("piece_bpe_32k.model")
    odd = docs_of(spark, [None, "", " ", "a", "Hello  world é 你 \n x", " " * 40 + "c" * 50, "aaa aaaa 日本 \U0001f600 \0a", "▁x ▁"])
    both = corpus.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text"))
    lib = SentencePieceProcessor(model_file=path)
    got = {r.doc_id: r for r in pieces.encode(both, path, with_ids=True).collect()}
    for r in both.collect():
        want = lib.encode(r.text or "", num_threads=1)
        assert got[r.doc_id].ids == want and got[r.doc_id].n_ids == len(want)
        text = (r.text or "").replace("▁", " ")
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


# -- 3 fingerprints

def test_fingerprints(spark, corpus, texts):
    got = {r.doc_id: r for r in fingerprint.report(corpus).collect()}
    order = sorted(texts, reverse=True)

    def jaccard(a, b):
        a, b = Counter(a.lower().split()), Counter(b.lower().split())
        return sum((a & b).values()) / max(1, sum((a | b).values()))
    error = []
    for d, nxt in zip(order, order[1:] + order[:1]):
        t, k = texts[d], len(texts[d]) // 3
        edited = t[:len(t) - k] + texts[nxt][:k]
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error += [got[d].near_edited - jaccard(t, edited), got[d].near_next - jaccard(t, texts[nxt])]
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.1
    by_text = defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in by_text.values())


def test_fingerprint_edge_cases(spark):
    rows = docs_of(spark, [None, "", "one two two", "one two two"]).union(spark.createDataFrame([(None, "last", None, None, None, None, None), (3, "one two two", None, None, None, None, None)], SCHEMA))
    got = fingerprint.report(rows).collect()
    assert len(got) == 6
    empty = [r for r in got if r.doc_id in (0, 1)]
    assert all(set(r.fingerprint) == {"0"} and r.n_chars == 0 for r in empty)
    assert [r.near_next for r in got if r.doc_id == 1] == [1.0]
    assert len({r.fingerprint for r in got if r.doc_id in (2, 3)}) == 1
    assert fingerprint.report(rows.where("false")).count() == 0
    only = fingerprint.report(rows.where("doc_id = 2")).first()
    assert only.near_next == 1.0


# -- 4 near duplicates

def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets, root = {d: shingles(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    index = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(o for g in s for o in index[g])
        for o, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[o]) - n):
                a, b = find(d), find(o)
                root[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def near_copies(n=60):
    """A base text, copies with a few changed words, texts sharing one passage, short and blank ones."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    out = [" ".join(base)] * 3
    for i in range(n):
        words = list(base)
        for p in rng.choice(120, rng.integers(1, 6), replace=False):
            words[p] = f"x{i}-{p}"
        out.append(" ".join(words))
    passage = " ".join(f"p{i}" for i in range(30))
    out += [" ".join(f"d{i}-{j}" for j in range(40)) + " " + passage for i in range(20)]
    return out + [None, "", " \n ", "A b c", "a B\tc", "a b c d", "One Two Three Four Five", "w " * 5000]


def test_ngram_join_against_brute_force(spark):
    rows = list(enumerate(near_copies()))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs_of(spark, [t for _, t in rows])).collect()}
    assert got == brute_components(rows)


def test_ngram_join_on_given_documents(spark, corpus, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(corpus).collect()}
    assert got == brute_components(sorted(texts.items()))


def test_ngram_join_repeated_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(5, text), (5, text), (None, text), (9, text + " more"), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.n_shingles, r.component_id or -1) for r in ngram_join.join(rows).collect())
    assert got == [(-1, 26, 5), (1, 0, 1), (5, 26, 5), (5, 26, 5), (9, 27, 5)]
    assert ngram_join.join(rows.where("false")).count() == 0


# -- 5 licenses

def test_license_scan(spark):
    mit = licenses.TEMPLATES["MIT-text"][1]
    broken = mit.replace("merge,", "").replace("Software without restriction", "Software with no restriction")
    docs = docs_of(spark, ["words " * 500 + "Released under the MIT License. " + "tail " * 500, broken, "the mit campus under the bridge", None, "",
                           "Released under the MIT License.\n" * 40, "Licensed under CC BY-NC 4.0."])
    got = {(r.doc_id, r.license): r for r in licenses.find(docs).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT-text"), (5, "MIT"), (6, "CC-BY-NC-4.0")}
    assert got[0, "MIT"].first_word == 500 and got[0, "MIT"].coverage == 1.0 and got[5, "MIT"].findings == 40
    assert 0.8 <= got[1, "MIT-text"].coverage < 1.0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_license_is_found_whole_and_without_its_key_words(name):
    key, template = licenses.TEMPLATES[name]
    full = licenses.words(template)
    text = lambda ws: " ".join(["x"] * 300 + ws + ["y"] * 300)
    scan = lambda ws: {f[0]: f[1:] for f in licenses.scan(text(ws))}
    assert scan(full)[name] == (1.0, 300, 300 + len(full), 1)
    assert scan(full * 5)[name] == (1.0, 300, 300 + len(full), 5)
    less = [w for w in full if w != key]
    found = scan(less)[name]
    assert found[0] == len(less) / len(full) and found[3] == 1
    missing = list(licenses.key_words(key, full))[: len(full) - licenses.least(len(full))]
    assert scan([w for w in full if w not in missing])[name][0] >= licenses.COVERAGE
    # each key word twice in a row: no window cut at it reaches the whole notice from both sides
    assert scan([x for w in full for x in ([w, w] if w == key else [w])])[name][0] == 1.0


def test_patience_alignment_is_increasing():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = [list(rng.choice(list("abcdefgh"), 20)) for _ in range(2)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
    assert licenses.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


# -- 6 nearest neighbours

def test_nearest_neighbours_recall(spark):
    frame = table(spark, SF, "embeddings")
    rows = frame.toPandas()
    x, ids = np.stack(rows["embedding"].to_numpy()).astype(float), rows["vec_id"].to_numpy()
    got = ann.search(frame, frame.where("vec_id % 20 = 0"), 20).toPandas()
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[got["query_id"] == ids[q]].sort_values("rank")
        hits += len(set(mine["vec_id"]) & set(ids[best]))
        total += min(20, len(ids) - 1)
        assert mine["score"].is_monotonic_decreasing
    assert hits / total >= 0.9


def test_nearest_neighbours_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
            (7, [1.0, None]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 0.0]), (11, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = ann.search(frame, frame.where("vec_id in (0, 3, 4)"), 3).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 2, 2.0), (0, 2, 1, 1.0), (0, 3, 9, 1.0)]
    assert ann.search(frame.where("false"), frame, 3).count() == 0
    assert ann.search(frame, frame.where("false"), 3).count() == 0


# -- 7 packing

def check_packing(rows, tokens):
    for key, total in tokens.items():
        own = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == key)
        assert sum(x[2] for x in own) == total and own[0][1] == 0
        assert all(a[1] + a[2] == b[1] for a, b in zip(own, own[1:]))
        assert all(x[2] == 1024 for x in own[1:])
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and s[-1][0] + s[-1][1] <= 1024
        assert all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:]))
    return len(sequences)


def test_packing_is_exact_and_tight(spark, corpus, texts):
    from tokenizers import Tokenizer
    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    odd = docs_of(spark, [None, "", "<|endoftext|>x", "it's  ²³ 日本 \U0001f600 \x1c ok", "a" * 30_000, "hi hi " * 9000])
    both = corpus.select("doc_id", "text").union(odd.select(F.col("doc_id") + 10_000, "text")).repartition(23)
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in both.collect()}
    rows = packing.pack(both, path).collect()
    used = check_packing(rows, {k: len(v) for k, v in ids.items()})
    for r in rows:
        data = np.array(ids[r.doc_id][r.start: r.start + r.length], dtype="<u4").tobytes()
        assert zlib.crc32(data) == r.ids_crc32
    assert used <= 1.08 * sum(map(len, ids.values())) / 1024  # 23 tiny partitions; large ones come within 1 %
    assert packing.pack(both.where("false"), path).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, places, fills = packing.best_fit(np.array([600, 500, 424, 400, 100, 24]), 1024)
    assert fills.tolist() == [1024, 1024] and max(places) < 1024
    assert bins[0] == bins[2] and bins[1] == bins[3] == bins[4] == bins[5]


# -- 8 chat

def test_perspective_rotation(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 3, "ann", "Bye"), (2, 0, "system", "alone"),
            (None, 0, None, "no id")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, start string")
    got = chat.views(frame).orderBy("perspective", "position").collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    view = [r for r in got if r.perspective == "ann"]
    full = "".join(r.segment for r in view)
    assert [r.speaker for r in view] == ["system", "assistant", "user name=bob", "assistant"]
    assert [full[r.mask_start: r.mask_end] for r in view] == ["", "Hi < |im_end|><|im_end|>\n", "", "Bye<|im_end|>\n"]
    assert [r.start for r in view] == [sum(len(x.segment) for x in view[:i]) for i in range(4)]


def test_perspective_blocks_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 7)
    frame = spark.range(50).selectExpr("1L as conv_id", "id as turn", "concat('r', id % 3) as role", "repeat('x', cast(id as int)) as text")
    for who in ("r0", "r1", "r2"):
        view = chat.views(frame).where(F.col("perspective") == who).orderBy("position").collect()
        assert [r.start for r in view] == np.cumsum([0] + [len(r.segment) for r in view[:-1]]).tolist()


# -- 9 personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    valid = {"email": lambda m: True, "ip": lambda m: all(int(p) <= 255 for p in m.split(".")),
             "card": lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 10 <= len(digits(m)) <= 15}
    return sorted((m.start(), k, m.end()) for k, (n, p) in enumerate(BASE.items()) for m in re.finditer(p, text) if valid[n](m.group()))


def test_personal_data_base_spans(spark, corpus, texts):
    odd = ["x a@b.c_d@e.f a@b.co.uk", "1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112", "+1 (212) 555-0000 +12",
           "\U0001f600 me@x.org 日本 +49 30 1234567890", "1" * 20_000 + " " + "a" * 20_000 + "@", "9 " * 5000 + "1.1.1.1.", None, ""]
    docs = corpus.select("doc_id", "text").union(docs_of(spark, odd).select(F.col("doc_id") + 10_000, "text"))
    want = {**texts, **{10_000 + i: t for i, t in enumerate(odd)}}
    for r in pii.report(docs).collect():
        spans = brute_spans(want[r.doc_id] or "")
        listed = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), r.doc_id
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert set(listed.split(",")) <= set(r.spans.split(",")) | {""}


def test_personal_data_bootstraps_contexts(spark):
    known = [f"Reach me, mail: user{100 + i}@x.org now" for i in range(6)] + [f"id={4111111111111111}, ok", "id=5500005555555559, ok", "id=4012888888881881, ok"]
    unseen = ["Reach me, mail: user777[at]x now", "id=99887766 ok", "room 1234 is free"]
    got = {r.doc_id: r.spans for r in pii.report(docs_of(spark, known + unseen)).collect()}
    assert "context" in got[9] and "context" in got[10] and got[11] == ""
    assert pii.report(docs_of(spark, known).where("false")).count() == 0


def context_spans(spark, known, unseen):
    """Whether each unseen text gets a context span."""
    got = {r.doc_id: r.spans for r in pii.report(docs_of(spark, known + unseen)).collect()}
    return ["context" in got[len(known) + i] for i in range(len(unseen))]


def test_personal_data_learns_patterns_of_discovered_instances(spark):
    known = [f"Kunde {c}" for c in ("4111111111111111", "5500005555555559", "4012888888881881")] * 10
    found = ["Kunde 12345", "Kunde 23456", "Kunde 34567"]
    known += found + [f.replace("Kunde", "Ref") for f in found] * 10 + ["raum 12345"] + ["raum frei"] * 10
    assert context_spans(spark, known, ["Ref 99999", "raum 777777"]) == [True, False]


def test_personal_data_seeds_need_no_digits(spark):
    known = ["mail an anna@x.org", "mail an bert@x.org", "mail an cora@x.org"] * 5
    assert context_spans(spark, known, ["mail an anna777[at]x", "ruf 777"]) == [True, False]
    inner = ["to=anna@x.org", "to=bert@x.org", "to=cora@x.org"] * 5
    assert context_spans(spark, inner, ["to=777888"]) == [True]
    assert context_spans(spark, inner + ["to=nobody"] * 20, ["to=777888"]) == [False]


def test_personal_data_seeds_may_hold_spaces(spark):
    known = ["Tel +49 30 1234567890", "Tel +49 40 2345678901", "Tel +49 89 3456789012"] * 5
    assert context_spans(spark, known, ["Tel 030/777888", "30 777888"]) == [True, False]


def test_personal_data_spans_of_one_token_share_its_word(spark):
    known = ["cc a@x.org,b@x.org,c@x.org", "cc d@x.org,1.2.3.4"] * 2
    assert context_spans(spark, known, ["cc 777888"]) == [True]
    assert context_spans(spark, known + ["cc none"] * 9, ["cc 777888"]) == [False]


def test_redaction_replaces_every_span(spark):
    docs = docs_of(spark, ["mail a@b.org or 10.0.0.1!", "clean", None])
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[0].text == "mail [EMAIL] or [IP]!" and got[0].n_chars == len(got[0].text)
    assert got[1].text == "clean" and got[2].text is None and pii.redact(docs).columns == docs.columns


# -- 10 pages

def test_main_text_of_given_pages(spark):
    pages = table(spark, SF, "pages")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)
        parts = re.split(r"</?(?:h1|p)>", article[1]) if article else []
        cleaned = (" ".join(html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " ")).split()) for p in parts)
        want[r.page_id] = "\n".join(p for p in cleaned if p)
    got = html_main.extract(pages).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_main_text_edge_cases(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<nav><li><a>x</a>"), (4, "u", "<p>unclosed <!-- c"), (5, "u", "<a b='" + "x" * 1000),
            (6, "u", "<article><h1>T</h1>" + "<p>A sentence of some length, with words &amp; marks.</p>" * 3000 + "</article>")]
    got = {r.page_id: r for r in html_main.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert len(got) == 6 and got[1].text == got[2].text == got[None].text == "" and got[6].text.count("\n") == 3000
    assert html_main.extract(table(spark, SF, "pages").where("false")).count() == 0


HIDDEN = ["<svg/>", "<svg viewBox='0 0 1 1' />", "<svg><path d='M0'/></svg>", "<svg><title/><text>label</text></svg>", "<div><svg></div>",
          "<object data=x>", "<object data='x' />", "<object><p>fallback</p></object>", "<object><object></object>fallback</object>",
          "<template>", "<template><div>row</div></template>", "<noscript>", "<noscript><p>no script</p></noscript>", "<iframe src=x>",
          "<iframe></iframe>"]


@pytest.mark.parametrize("hidden", HIDDEN)
def test_hidden_elements_swallow_nothing_else(hidden):
    page = "<body>{}<article><h1>Title</h1><p>A sentence{} of some length.</p></article>{}<p>End.</p>"
    want = [b.text for b in html_main.blocks(page.format("", "", ""))]
    inline = hidden if hidden != "<div><svg></div>" else "<svg>"
    for places in ((hidden, "", ""), ("", inline, ""), ("", "", hidden), (hidden, inline, hidden)):
        got = html_main.blocks(page.format(*places))
        assert [b.text for b in got] == want
        assert not any(t in html_main.HIDDEN_TAGS for b in got for t, _ in b.ancestors)


def test_end_tag_belongs_to_the_innermost_hidden_element():
    page = "<object><article><p>Kept.</p></article><object><p>fallback</p></object><div><svg></div><p>Kept too.</p></svg>"
    assert [b.text for b in html_main.blocks(page)] == ["Kept.", "Kept too."]


def test_viterbi_is_the_best_labelling():
    model = html_main.train([])
    page = html_main.features(html_main.blocks(html_main._examples()[1][0]))

    def value(y):
        s = sum(model["feature"].get(f, [0, 0])[l] for fs, l in zip(page, y) for f in fs)
        return s + sum(model["trans"][a][b] for a, b in zip(y, y[1:]))
    best = max(value([n >> i & 1 for i in range(len(page))]) for n in range(1 << len(page)))
    assert value(html_main.decode(page, model)) == pytest.approx(best)
