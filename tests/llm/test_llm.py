"""The operators against brute force on small fixtures, and their edge cases."""

import collections
import hashlib
import json
import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm import decontaminate, eliasfano, jaccard, langid, licenses, mixing, ngramlm, pqdedup, sharding, suffixdedup, toolcalls

DOCS = "doc_id long, text string, lang string, source string, shard string, score string, n_words string"


def corpus():
    rng = random.Random(5)
    en, fr = "the and of house water green train running windy".split(), "le la des maison rivière forêt pluie gâteau où".split()
    text = lambda ws, n: " ".join(rng.choice(ws) + str(rng.randrange(9)) * rng.randrange(2) for _ in range(n))
    docs = [(i, text(en if i % 3 else fr, rng.randrange(1, 120)), "en" if i % 3 else "fr", f"s{i % 4}") for i in range(60)]
    base = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))
    docs += [(100 + i, base, "en", "s0") for i in range(5)]
    for i in range(6):
        ws = base.split()
        ws[20 * i + 7] = f"edit{i}"
        docs.append((120 + i, " ".join(ws), "en", "s1"))
    passage = " ".join(f"p{k}" for k in range(120))
    docs += [(140 + i, f"{text(en, 30)} {passage} {text(en, 40)}", "en", "s2") for i in range(4)]
    docs += [(200, None, None, None), (201, "", "en", "s3"), (202, "12 34 !!", None, "s3"), (203, "one", "en", None), (204, "one two", "en", None)]
    docs += [(205, "ha " * 600, "en", "s3"), (206, "é" * 900, "fr", "s3"), (207, "Released under the MIT License. MIT license", "en", "s3")]
    docs += [docs[3], docs[3], (None, "no id here at all", "en", "s1"), (208, "word " * 30_000, "en", "s1")]
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "x", "y", "z") for r in corpus()]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(t):
    return (t or "").encode().lower().split()


def alnum(t):
    from millrace.llm.common import words_of

    return words_of((t or "").encode())


def components(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_jaccard(docs, empty):
    rows = corpus()
    sets = {}
    for d, t, *_ in rows:
        w = words(t)
        sets[d] = frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()
    ids = [d for d in sets if d is not None]
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    want = components(ids, links)
    got = jaccard.jaccard_components(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == want.get(r.doc_id)
    assert len(set(want[i] for i in range(120, 126))) == 1
    assert jaccard.jaccard_components(empty).count() == 0


def test_decontamination(spark, docs, empty):
    long_item = " ".join(f"p{k}" for k in range(30, 60))
    items = [(1, long_item), (2, "one"), (3, None), (4, "!!"), (5, "House WATER"), (None, "one"), (2, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (2_000_000, 10):
        got = decontaminate.find_contamination(docs, bench, block_words=block_words).collect()
        assert len(got) == len(corpus())
        for r in got:
            w = alnum(r.text)
            hit, own = set(), set()
            for item, t in items:
                q = alnum(t)
                n = min(13, len(q))
                for s in range(len(q) - n + 1 if n and item is not None else 0):
                    for a in range(len(w) - n + 1):
                        if w[a : a + n] == q[s : s + n]:
                            hit.update(range(a, a + n))
                            own.add(str(item))
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(own))
            assert r.input_n_words == "z"
    assert decontaminate.find_contamination(empty, bench).count() == 0
    assert decontaminate.find_contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0


def test_suffix_dedup(docs, empty):
    length, rows = 80, corpus()
    count = collections.Counter()
    for _, t, *_ in rows:
        raw = (t or "").encode()
        count.update(raw[i : i + length] for i in range(len(raw) - length + 1))
    want = collections.Counter()
    for d, t, *_ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - length + 1):
            if count[raw[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(raw, gone, strict=False) if not g)
        edges = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[d, len(raw), int(gone.sum()), edges, hashlib.sha256(kept).hexdigest()] += 1
    for hot in (4000, 1):
        got = suffixdedup.remove_repeats(docs, length=length, anchor=50, hot=hot).collect()
        assert collections.Counter(tuple(r) for r in got) == want
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_suffix_sort_uses_the_cover():
    assert all(any((i + d) % 64 in suffixdedup.COVER and (j + d) % 64 in suffixdedup.COVER for d in range(64)) for i in range(64) for j in range(64))
    rng = np.random.default_rng(2)
    base = bytes(rng.integers(97, 99, 900, dtype=np.uint8))
    contexts = [base[:600], base[5:560], b"a" * 520, b"a" * 450, base[100:640]]
    starts = np.array([len(c) - 399 for c in contexts])
    at = np.array([150, 145, 120, 50, 50])
    got = suffixdedup.sort_block(np.zeros(5, np.int64), at, contexts, starts)
    for i, c in enumerate(contexts):
        for s in range(starts[i]):
            same = [(j, u) for j, e in enumerate(contexts) for u in range(starts[j]) if at[j] - u == at[i] - s and j != i and e[u : u + 400] == c[s : s + 400]]
            assert got[i][s] == bool(same)


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, u in ((0, 9), (1, 5), (700, 1 << 60), (900, 900)):
        v = np.arange(n, dtype=np.uint64) if n == u else np.unique(rng.integers(0, u, n, dtype=np.uint64))
        e = eliasfano.EliasFano.build(v, u)
        assert (e.get(np.arange(len(v))) == v).all()
        q = rng.integers(0, u, 500, dtype=np.uint64)
        assert (e.find(v) == np.arange(len(v))).all()
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


def test_language_model(docs, empty):
    rows = corpus()
    train = [t for d, t, *_ in rows if d is not None and d % 5]
    c, pairs = collections.Counter(), collections.Counter()
    for t in train:
        w = [*words(t), None]
        c.update(w)
        pairs.update(zip([None, *w], w, strict=False))
    n, v = sum(c.values()), len(c)
    model = ngramlm.train(docs.where("doc_id % 5 <> 0").select("text"), shard_tokens=5000)
    assert (model.tokens, model.words) == (n, v)
    for r in ngramlm.score(docs, model).collect():
        w = [*words(r.text), None]
        p = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
        assert r.n_tokens == len(w) and r.n_known == sum(c[x] > 0 for x in w)
        assert math.isclose(r.base_score, sum(math.log10(p(x)) for x in w), rel_tol=1e-9)
        want = 0.0
        for a, b in zip([None, *w], w, strict=False):
            kept = {y: k for (x, y), k in pairs.items() if x == a and k > 1} if len(w) < 40 else None
            if kept is None:
                break
            stored = (kept[b] - 0.75) / c[a] if b in kept else 0
            want += math.log10(stored + (1 - sum((k - 0.75) / c[a] for k in kept.values())) * p(b) if c[a] else p(b))
        else:
            assert abs(r.lm_score - want) < 0.06 * len(w)  # quantised
    assert ngramlm.score(empty, model).count() == 0
    assert ngramlm.score(docs, ngramlm.train(empty.select("text"))).where("n_known > 0").count() == 0


def test_language_model_query_keeps_pairs_seen_once(spark, tmp_path):
    from millrace.llm import queries

    texts = [f"a{i} b{i} c{i} d{i}" for i in range(20)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.QUERIES["op2_elias_fano_lm"](spark, str(tmp_path)).collect()}
    train = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 != 1]
    n, v, k = 5 * len(train), 4 * len(train) + 1, len(train)
    p = lambda count: (count + 0.5) / (n + 0.5 * (v + 1))
    for i in train:
        first = 0.25 / k + 0.75 * p(1)  # the end is the context, seen k times with k successors
        want = math.log10(first) + 3 * math.log10(0.25 + 0.75 * p(1)) + math.log10(0.25 + 0.75 * p(k))
        assert not got[i].held_out and abs(got[i].score - want) < 0.06 * 5


def test_language_id(docs, empty):
    model = langid.fit([(t, lang) for d, t, lang, _ in corpus() if t and lang and d is not None and d % 4])
    got = langid.identify(docs, model).collect()
    assert len(got) == len(corpus())
    for r in got:
        if not r.text or not any(ch.isalpha() for ch in r.text):
            assert r.lang_pred == "und" and r.score == 0
        elif r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == r.lang
        assert 0 <= r.score <= 1 and r.input_score == "y"
    assert langid.identify(empty, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit([])).collect()} == {"und"}


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)))
    s = rng.normal(size=(9, 3)).astype(np.float32)
    got = m.marginals(s, np.array([4, 5]))
    for a, b in ((0, 4), (4, 9)):
        total, marg = 0.0, np.zeros((b - a, 3))
        for path in np.ndindex(*(3,) * (b - a)):
            w = math.exp(sum(s[a + i, y] for i, y in enumerate(path)) + sum(m.trans[x, y] for x, y in zip(path, path[1:], strict=False)))
            total += w
            for i, y in enumerate(path):
                marg[i, y] += w
        assert np.allclose(got[a:b], marg / total, atol=1e-5)


def test_sharding(docs, empty):
    got = sharding.assign_shards(docs, shards=4).collect()
    assert len(got) == len(corpus())
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert set(by) <= set(range(4)) and all(sorted(x) == list(range(len(x))) for x in by.values())
    text = {d: t for d, t, *_ in corpus()}
    for r in got:
        raw = text[r.doc_id]
        assert r["size"] == len((raw or "").encode()) + 16 and r.text_crc32 == zlib.crc32((raw or "").encode())
    assert len({r.shard for r in got if r.doc_id is not None and 100 <= r.doc_id < 105}) == 1  # equal texts together
    assert sharding.assign_shards(empty).count() == 0
    staged = sharding.shard_stage(docs, shards=4)
    assert staged.count() == len(corpus()) and "input_shard" in staged.columns
    items = np.random.default_rng(3).random((4000, 3)) / 1000
    loads = np.zeros((40, 3))
    np.add.at(loads, sharding.pack(items / items.sum(0) * 40, 40), items / items.sum(0) * 40)
    assert abs(loads - 1).max() < 0.02


def test_hot_group_is_split(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "if(id < 1500, 'same text', concat('t', id)) as text")
    sizes = sharding.assign_shards(many, shards=10).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in sizes) < 1.1 * min(r[1] for r in sizes)


def test_mixing(docs, empty):
    rows = corpus()
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), sum(size.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        for s in over or list(open_):
            target[s] = 3 * size[s] if over else level * weight[s]
            left -= target[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
        assert r.positions is None or (r.positions == sorted(r.positions) and 0 <= r.positions[0] and r.positions[-1] <= 1)
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.mix_stage(empty).count() == 0
    assert mixing.mix_stage(docs).count() == sum(r.passes for r in got)


def test_licences(docs, empty):
    got = licenses.scan(docs).collect()
    assert len(got) == len(corpus())
    text = {d: t for d, t, *_ in corpus()}
    for r in got:
        w = [x.decode() for x in alnum(text[r.doc_id])]
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            p = phrase.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert r.base_labels == ",".join(sorted(labels)) and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert licenses.scan(empty).count() == 0


def test_licence_templates(spark):
    texts = [(t, f"some file header {notice.upper()}. and more") for t, (_, notice, _) in enumerate(licenses.TEMPLATES)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for t, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[t].labels.split(","), label


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16))
    x[300:340] = x[0] + rng.normal(size=(40, 16)) * 0.08
    x[340:350] = x[1]
    x[350:360] = x[2] * 7
    rows = [(i, [float(v) for v in e], "c") for i, e in enumerate(x)]
    rows += [(500, None, "c"), (501, [0.0] * 16, "c"), (502, [float("nan")] + [1.0] * 15, "c"), (503, [None] + [1.0] * 15, "c"), (504, [float("inf")] + [1.0] * 15, "c"), (505, [], "c")]
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.95
    want = components(range(400), zip(*np.nonzero(near), strict=True))
    got = {r.vec_id: r for r in pqdedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, kept string").repartition(3), slack=1.0).collect()}
    for i in range(400):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (near[i].sum() - 1, want[i], want[i] == i)
    for i in range(500, 506):
        assert tuple(got[i]) == (i, 0, i, True)
    assert pqdedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_tool_calls(spark):
    call = lambda i, name, args: "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": args}) + "</tool_call>"
    answer = lambda i: "<tool_result>" + json.dumps({"id": i, "content": 1}) + "</tool_result>"
    rows = [
        (1, 0, "user", "héllo"),
        (1, 1, "assistant", "let me " + call("b", "search", {"query": "$a"}) + call("a", "search", {"query": "x", "limit": 2})),
        (1, 2, "tool", answer("a") + answer("b")),
        (1, 3, "assistant", call("a", "search", {"query": "again"}) + call("c", "search", {"limit": "3"}) + call("d", "nope", {})),
        (1, 4, "assistant", call("e", "search", {"query": "$f"}) + call("f", "search", {"query": "$e"}) + "<tool_call>{bad</tool_call>"),
        (2, 0, "tool", answer("a")),
        (2, 1, "tool", answer("z")),
        (2, 2, "assistant", call("z", "search", {"query": "late"})),
        (3, 0, None, None),
        (None, 0, "assistant", call("q", "search", {"query": "no conversation"})),
    ]
    schemas = spark.createDataFrame([("search", '{"properties":{"query":{"type":"string"},"limit":{"type":"integer"}},"required":["query"]}'), (None, "{}")], "name string, schema string")
    conversations = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, level string")
    got = toolcalls.link(conversations, schemas).collect()
    at = {(r.conv_id, r.turn, r.part): r for r in got}
    assert len(got) == 24 and len(at) == 24
    state = lambda *k: (at[k].kind, at[k].call_id, at[k].level, at[k].linked, at[k].problem)
    assert state(1, 1, 1) == ("call", "b", 2, True, None) and state(1, 1, 2) == ("call", "a", 0, True, None)
    assert state(1, 2, 1) == ("result", "a", 1, True, None) and state(1, 2, 2) == ("result", "b", 3, True, None)
    assert state(1, 3, 1)[3:] == (False, "duplicate id") and at[1, 3, 2].problem == "missing query" and at[1, 3, 3].problem == "unknown tool"
    assert at[1, 4, 1].problem == at[1, 4, 2].problem == "cycle" and at[1, 4, 3].problem == "malformed"
    assert at[2, 0, 1].problem == "orphan result" and at[2, 1, 1].problem == "result before its call"
    assert at[1, 0, 0].canonical == '{"content":"héllo","role":"user"}' and at[3, 0, 0].canonical == '{"content":"","role":null}'
    assert at[1, 1, 2].canonical == '{"arguments":{"limit":2,"query":"x"},"id":"a","name":"search"}'
    assert not at[None, 0, 1].linked
    assert toolcalls.link(conversations.limit(0), schemas).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(d, t, lang, s, 1) for d, t, lang, s in corpus()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(30, 90)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns = d.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, d = d, stage(spark, d, sf).cache()
        ids = [r.doc_id for r in d.collect()]
        assert d.columns[: len(columns)] == columns
        if k == 0:
            assert not {200, 201, 202} & set(ids) and {0, 203, 205} <= set(ids)
        if k == 1:
            assert 100 in ids and not set(range(101, 105)) & set(ids) and ids.count(3) == 1
        if k == 2:
            assert not set(range(140, 144)) & set(ids)
        if k == 3:
            assert set(ids) <= {r.doc_id for r in before.collect()}
    assert d.columns == [*columns, "shard"] and {r.shard for r in d.collect()} <= set(range(40))


@pytest.mark.parametrize("name", ["op4_tool_call_linking", "op5_pq_near_duplicates", "op6_jaccard_join", "op7_curriculum_mix", "op8_positional_licence_scan", "op9_prefix_decontamination", "op10_suffix_dedup"])
def test_queries_match_sql(spark, name):
    import duckdb

    from millrace.llm import queries

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    head = [x[0] for x in cur.description]
    near = lambda v: round(v, 9) if isinstance(v, float) else [near(x) for x in v] if isinstance(v, list) else v
    rows = lambda found: sorted(repr(tuple(map(near, r))) for r in found)
    assert rows(cur.fetchall()) == rows(queries.QUERIES[name](spark, sf).select(*head).collect())


def test_pipeline_links_near_copies_between_both_laws(spark):
    import corpus_pipeline

    base = [f"w{k}" for k in range(200)]
    copy = [f"edit{k}" if k in (20, 70, 120, 170) else w for k, w in enumerate(base)]
    cut = lambda w, n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    jac = lambda n: len(cut(base, n) & cut(copy, n)) / len(cut(base, n) | cut(copy, n))
    assert jac(3) < 0.9 and 0.8 < jac(5) < 0.9
    rows = [(1, " ".join(base)), (2, " ".join(copy)), (3, " ".join(f"x{k}" for k in range(200)))]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, d, "").collect()) == [1, 3]


def test_pipeline_keeps_texts_without_any_label(spark):
    import corpus_pipeline

    texts = ["some words here", "élan", "12 34 !!", "", None, "one"]
    d = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, d, "")
    assert out.columns == d.columns and sorted(r.doc_id for r in out.collect()) == [0, 1, 5]


def test_language_features_of_few_words_at_once():
    """pipeline: new words are scored some at a time, as their features and rows of weights fill a worker's memory."""
    rng = np.random.default_rng(1)
    taken = []

    class Weights(np.ndarray):
        def __getitem__(self, at):
            taken.append(len(at))
            return np.asarray(self)[at]

    emit = rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], emit, np.zeros((3, 3)))
    model.emit = emit.view(Weights)
    words = [f"w{chr(97 + i % 26)}{i}ab" for i in range(20_000)]
    at = model.ids(words)
    got = model.rows[at]
    assert max(taken) <= 200_000 < sum(taken)
    for i in (0, 3_999, 4_000, 19_999):
        f = langid.features(words[i])
        assert np.allclose(got[i], emit[f].sum(axis=0) / np.sqrt(len(f)), atol=1e-5)
