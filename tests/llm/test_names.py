"""Extra columns whose names clash with those that the operators add or use on the way."""

import json
import random

import pytest

from millrace.llm import common, decontaminate, jaccard, langid, mixing, ngramlm, sharding, toolcalls

EXTRA = "n_words input_n_words _n _h _at _k _a pieces grp dh held row shard input_shard lang_pred input_lang_pred lm_score SCORE at id k th _items worded".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab cd ef gh ij".split()) + str(rng.randrange(50)) for _ in range(30)), "en" if i % 2 else "fr", f"s{i % 3}") for i in range(30)]
    rows += [(30, rows[0][1], "en", "s0"), (None, rows[0][1], "en", "s0"), (None, rows[1][1] + " x", "en", "s0"), (None, "alone one two three four five six", "en", "s0"), (1, "another text of id one", "en", "s1"), (40, None, None, None)]
    return spark.createDataFrame([(*r, *(f"{c}-{r[0]}" for c in EXTRA)) for r in rows], ", ".join(["doc_id long", "text string", "lang string", "source string", *(f"{c} string" for c in EXTRA)]))


def kept(row, aside):
    return all(row[aside.get(c, c)] == f"{c}-{row['doc_id']}" for c in EXTRA)


def test_set_aside(spark):
    df = spark.createDataFrame([(1, 2, 3)], "N_Words int, input_n_words int, input_N_Words2 int")
    assert common.set_aside(df, ["n_words"]) == {"N_Words": "input_input_N_Words"}
    assert common.set_aside(df, ["other"]) == {}


def test_operators_keep_clashing_columns(spark, docs):
    bench = spark.createDataFrame([(1, "ab1 cd2")], "item_id long, text string")
    model = langid.fit([(r.text, r.lang) for r in docs.collect() if r.text])
    trie = ngramlm.train(docs.select("text"))
    results = [
        (decontaminate.find_contamination(docs, bench), decontaminate.NEW),
        (langid.identify(docs, model), langid.NEW),
        (ngramlm.score(docs, trie), ("n_tokens", "n_known", "train_tokens", "base_score", "lm_score")),
        (sharding.shard_stage(docs, shards=3), ("shard",)),
    ]
    for out, new in results:
        rows = out.collect()
        assert len(rows) == docs.count()
        assert all(kept(r, common.set_aside(docs, new)) for r in rows)


def test_stages_keep_clashing_columns(spark, docs):
    import corpus_pipeline

    for stage in (corpus_pipeline.language, corpus_pipeline.near_duplicates, lambda s, d, p: mixing.mix_stage(d)):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(kept(r, {}) for r in rows)


def test_one_of_each_takes_rows_without_id_and_repeated_ids(docs):
    got = {(r.doc_id, r.text) for r in jaccard.one_of_each(docs, shingle=3, percent=80).collect()}
    rows = docs.collect()
    assert (0, rows[0].text) in got and (30, rows[0].text) not in got and (None, rows[0].text) not in got
    assert (None, rows[1].text + " x") not in got and (1, rows[1].text) in got and (1, "another text of id one") in got
    assert (None, rows[33].text) in got and (40, None) in got


def test_levels_settle_like_brute_force(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for conv in range(12):
        calls = {f"n{i}": sorted({f"n{rng.randrange(9)}" for _ in range(rng.randrange(3))}) for i in range(rng.randrange(1, 9))}
        real = {k: [x for x in v if x in calls] for k, v in calls.items()}

        def level(k, path=()):
            if k in path:
                return None
            below = [level(x, (*path, k)) for x in real[k]]
            return None if None in below else 1 + max(below, default=-1)

        want |= {(conv, k): level(k) for k in calls}
        for t, (k, v) in enumerate(calls.items()):
            rows.append((conv, t, "assistant", "<tool_call>" + json.dumps({"id": k, "name": "f", "arguments": {str(i): f"${x}" for i, x in enumerate(v)}}) + "</tool_call>"))
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for limit in (100_000, 0):
        got = {(r.conv_id, r.call_id): r.level for r in toolcalls.link(conv, limit=limit).where("kind = 'call'").collect()}
        assert got == {k: None if v is None else 2 * v for k, v in want.items()}


def test_schemas_are_followed_inside():
    schema = {
        "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "object", "required": ["b"], "properties": {"b": {"type": ["integer", "null"], "minimum": 2}}}, "c": {"type": "array", "items": {"type": "string", "pattern": "^x", "maxLength": 3}}, "d": {"enum": [1, 2]}},
    }
    check = lambda v, met=(): toolcalls.schema_problem(v, schema, frozenset(met))
    assert check({"a": {"b": 3}, "c": ["x", "xy"], "d": 2}) is None and check({"a": {"b": None}}) is None
    assert check([]) == "type of arguments" and check({}) == "missing a" and check({"a": {}}) == "missing a.b"
    assert check({"a": {"b": 1}}) == "range of a.b" and check({"a": {"b": "z"}}) == "type of a.b" and check({"a": {"b": True}}) == "type of a.b"
    assert check({"a": {"b": 2}, "c": ["x", "y"]}) == "pattern of c[1]" and check({"a": {"b": 2}, "c": ["xxxx"]}) == "length of c[0]"
    assert check({"a": {"b": 2}, "d": 3}) == "value of d" and check({"a": {"b": 2}, "e": 3}) == "unknown e"
    assert check({"a": "$k"}) == "type of a" and check({"a": "$k"}, ["k"]) is None


def test_repeats_of_400_bytes_go_and_shorter_ones_stay(spark):
    """Production lengths: passages of more than 50 words, some under 400 bytes, planted in two texts each."""
    from millrace.llm import suffixdedup

    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows, want = [], {}
    for k in range(24):
        passage = " ".join(word(rng.choice((4, 5, 7, 9) if k % 3 else (4, 5, 6))) for _ in range(51 + 2 * k))
        for copy in range(2):
            rows.append((2 * k + copy, f"{' '.join(word(6) for _ in range(20))} {passage} {' '.join(word(6) for _ in range(20))}"))
            want[2 * k + copy] = len(passage) >= 400
    rows += [(100 + i, " ".join(word(6) for _ in range(120))) for i in range(20)]
    got = {r.doc_id: r for r in suffixdedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {False, True} == set(want.values())
    for i, t in rows:
        assert (got[i].n_removed > 0) == want.get(i, False) or want.get(i) is False and abs(400 - 2 - max(len(t) - 280, 0)) < 5
        assert got[i].n_bytes == len(t.encode())


def test_hostile_calls_have_a_defined_problem(spark):
    """Deep, broken or surrogate-laden blocks and schemas that are none: a row each, no crash."""
    call = lambda i, args, name="f": '<tool_call>{"name": "%s", "id": "%s", "arguments": %s}</tool_call>' % (name, i, args)
    deep = '{"a":' * 3_000 + "1" + "}" * 3_000
    texts = [
        call("deep", deep), call("nan", '{"a": NaN}'), call("big", '{"a": 1e400}'), call("brackets", "[" * 200_000), call("half", '{"a": "\\ud800"}'), call("\\ud83d", "{}"), call("whole", '{"n": 1.0}', "int"), call("true", '{"n": true}', "one"),
        call("pattern", '{"a": "x"}', "pattern"), call("minimum", '{"a": 1}', "minimum"), call("yes", '{"a": 1}', "yes"), call("no", '{"a": 1}', "no"), call("text", "{}", "text"), call("digits", '{"a": ' + "1" * 5_000 + "}"), call("list", "[1]", "int"), "<tool_call>" * 50,
    ]
    schemas = [("f", "{}"), ("int", '{"properties": {"n": {"type": "integer"}}}'), ("one", '{"properties": {"n": {"enum": [1]}}}'), ("pattern", '{"properties": {"a": {"pattern": "("}}}'), ("minimum", '{"properties": {"a": {"minimum": "1"}}}'), ("yes", '{"properties": {"a": true}}'), ("no", '{"properties": {"a": false}}'), ("text", '"x"')]
    conv = spark.createDataFrame([(1, i, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = toolcalls.link(conv, spark.createDataFrame(schemas, "name string, schema string")).where("kind = 'call'").collect()
    bad = {r.turn for r in out if r.problem == "malformed"}
    assert bad == {0, 1, 2, 3, 13} and all(r.canonical is None for r in out if r.turn in bad)
    assert {r.call_id: r.problem for r in out if r.turn not in bad} == {
        "half": "unanswered", "\ufffd": "unanswered", "whole": "unanswered", "true": "value of n", "pattern": "schema", "minimum": "schema", "yes": "unanswered", "no": "value of a", "text": "schema", "list": "type of arguments",
    }
    assert next(r.canonical for r in out if r.call_id == "half") == '{"arguments":{"a":"\ufffd"},"id":"half","name":"f"}'
