"""Edge cases of every text operator, and brute-force twins where SQL has none."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chipmeter.llm import chat, decontam, exact_dedup, langid, mixing, quality, secrets, simhash, substring_dedup, toxicity
from chipmeter.llm.common import materialise

SCHEMA = "doc_id long, text string, lang string, source string, rank int, dig string, row int, epoch string, _id int, hit int"


def docs(spark, rows):
    """Rows of (doc_id, text, lang, source) beside columns whose names clash with what operators use inside."""
    return materialise(spark.createDataFrame([(*r, 7, "d", 8, "e", 9, 1) for r in rows], SCHEMA))


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    para = " ".join(rng.choice(words) for _ in range(80))
    rows = [(1, None, "en", "src0"), (2, "", None, None), (3, " \t\n", "en", "src1"), (4, long, "de", "src0"), (5, long + " end", "de", "src0"), (6, para, "fr", "src2"), (6, para, "fr", "src2")]
    rows += [(7, para.replace(" ", "\n"), "fr", "src2"), (8, "x " + para + " y", None, "odd name"), (None, para, "fr", "src3"), (None, None, None, None), (9, "Tiny \u0000 text", "en", "src4")]
    rows += [(100 + k, para + f" tail {k}", "en", "src0") for k in range(20)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, [])


def test_exact_dedup_edges(spark, odd, none):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(odd).collect()}
    assert (1, 1, 4, False) not in got and (3, 3, 4, True) in got and (1, 3, 4, False) in got  # longest of the empty ones
    assert (6, 6, 4, True) in got and (7, 6, 4, False) in got and (None, 6, 4, False) in got
    left = exact_dedup.deduplicate(odd)
    assert left.columns == odd.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({3, 4, 5, 6, 8, 9, *range(100, 120)})
    assert exact_dedup.decisions(none).count() == exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("weak", [lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1), lambda c: F.lit("same")])
def test_exact_dedup_compares_contents(spark, odd, weak):
    strip = lambda rows: sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in rows)
    assert strip(exact_dedup.decisions(odd, digest_of=weak, salts=3).collect()) == strip(exact_dedup.decisions(odd).collect())


def brute_components(fps, radius=3):
    u = sorted(set(fps))
    root = {x: x for x in u}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(u, 2):
        if bin((a ^ b) & (2**64 - 1)).count("1") <= radius:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {x: find(x) for x in u}


@pytest.mark.parametrize("cap,parts", [(4096, 4), (5, 4), (5, 2), (4096, 3)])
def test_simhash_links_match_brute_force(spark, cap, parts):
    rng = np.random.default_rng(cap + parts)
    base = rng.integers(-(2**63), 2**63, 6)
    fps = [int(b) for b in base]
    for b in base:  # clusters around each base, and chains out of them
        for _ in range(15):
            x = int(b)
            for bit in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.append(x)
    df = spark.createDataFrame([(f,) for f in set(fps)], "fp long")
    df = materialise(df)
    edges = simhash.links(df, parts=(parts,), bin_cap=cap)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = brute_components(fps)
    got = {}
    for f in set(fps):
        got.setdefault(roots.get(f, f), set()).add(f)
    expect = {}
    for f, r in want.items():
        expect.setdefault(r, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expect.values()))


def test_simhash_fingerprint_and_edges(spark, odd, none):
    import xxhash

    words = "One two THREE four".split()
    grams = [" ".join(w.lower() for w in words[i : i + 3]) for i in range(2)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 2)
    assert simhash.fingerprint(" ".join(words).encode()) & (2**64 - 1) == want
    assert simhash.fingerprint(b" \n") == 0 and simhash.fingerprint(b"A b") == simhash.fingerprint(b"a  B")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (6, 6), (7, 6), (None, 6)} <= got
    left = simhash.deduplicate(odd)
    assert left.columns == odd.columns and {1, 6} <= {r.doc_id for r in left.collect()} and not {2, 3, 7, None} & {r.doc_id for r in left.collect()}
    assert simhash.near_duplicates(none).count() == 0


def test_decontamination(spark, odd, none):
    bench = spark.createDataFrame([(1, "Alpha BETA gamma, delta epsilon zeta eta theta iota kappa lambda"), (2, "short one"), (3, None), (4, "!!"), (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    text = "Start, alpha beta gamma delta epsilon: zeta eta theta iota kappa lambda. And a SHORT  one, too"
    d = docs(spark, [(1, text, None, None), (2, None, None, None), (3, "short two", None, None), (3, "short two", None, None), (None, "a short one", None, None), (5, "one short", None, None)])
    rows = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontam.report(d, bench).collect()}
    assert rows == {(1, 17, 13, 3, True), (2, 0, 0, 0, False), (3, 2, 0, 0, False), (None, 3, 2, 1, True), (5, 2, 0, 0, False)}
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [2, 3, 3, 5]
    spans = decontam.decontaminate(d, bench, remove="spans")
    assert spans.columns == d.columns
    assert {r.text for r in spans.where("doc_id = 1").collect()} == {"Start,     :      . And a   , too"}
    assert decontam.report(d, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.report(none, bench).count() == 0
    grams = decontam.windows(bench)
    plain = lambda df: sorted((str(r["_id"]), r["_text"] or 0, r.n_words, sorted((f.start, f.len, f.gram) for f in r.found)) for r in df.collect())
    whole = plain(decontam.candidates(d, grams))
    assert decontam.hits(decontam.candidates(d, grams), grams).count() == 2
    very_long = docs(spark, [(1, "filler words " * 60_000 + text, None, None), (1, "filler words " * 60_000 + text, None, None)])
    assert {(r.n_words, r.n_hit) for r in decontam.report(very_long, bench).collect()} == {(120_017, 13)}
    for broadcast in (99, 0):  # a set too large for the plan is joined
        assert plain(decontam.candidates(d, grams, block=2, broadcast=broadcast)) == whole


def brute_mix(rows, plan):
    """rows (doc_id, domain, lang, source, tokens) to {(doc_id, epoch)}; a recursive twin of the tree."""
    import hashlib

    leaves = {}
    for r in rows:
        if r[4] > 0:
            leaves.setdefault(tuple(x or "" for x in r[1:4]), []).append(r)
    cap = {k: sum(r[4] for r in v) * plan.max_epochs for k, v in leaves.items()}
    weights = [(plan.domains, plan.default_domain), (plan.langs, plan.default_lang), (plan.sources, plan.default_source)]
    quota = {}

    def down(prefix, budget):
        level = len(prefix)
        if level == 3:
            quota[prefix] = budget
            return
        kids = sorted({k[: level + 1] for k in leaves if k[:level] == prefix})
        table, default = weights[level]
        c = {k: sum(v for leaf, v in cap.items() if leaf[: level + 1] == k) for k in kids}
        w = {k: table.get(k[-1], default) for k in kids}
        share, open_kids = {}, [k for k in kids if w[k] > 0]
        while True:  # fill up whoever can take no more, again and again
            left, total = budget - sum(share.values()), sum(w[k] for k in open_kids)
            full = [k for k in open_kids if c[k] * total <= w[k] * left]
            if not full:
                break
            k = min(full, key=lambda x: (c[x] / w[x], x))
            share[k] = c[k]
            open_kids.remove(k)
        for k in open_kids:
            share[k] = w[k] * left // total
        for k in share:
            down(k, share[k])

    total = sum(cap.values())
    down((), min(total, total // plan.max_epochs * plan.percent // 100))
    out = set()
    for k, q in quota.items():
        size = sum(r[4] for r in leaves[k])
        passes, rest = divmod(q, size)
        out |= {(r[0], e) for r in leaves[k] for e in range(passes)}
        run = 0
        for r in sorted(leaves[k], key=lambda r: (hashlib.md5(f"{plan.seed}:{passes}:{r[0]}".encode()).hexdigest(), r[0])):
            run += r[4]
            if run <= rest:
                out.add((r[0], passes))
    return out


@pytest.mark.parametrize("percent,epochs", [(60, 2), (150, 3), (10, 1), (100, 1)])
def test_mixing_matches_recursive_twin(spark, percent, epochs):
    rng = random.Random(percent)
    rows = [(k, rng.choice(["web", "books", None, "rare"]), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3"]), rng.choice([0, 5, 20, 300])) for k in range(400)]
    rows = [r if r[1] != "rare" else (*r[:4], min(r[4], 5)) for r in rows]
    plan = mixing.Plan(domains={"web": 5, "books": 0, "rare": 9}, percent=percent, max_epochs=epochs)
    df = materialise(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, d string, lang string, source string, n long, domain string, tokens int"))
    got = mixing.mix(df, plan, domain=F.col("d"), tokens=F.col("n"))
    assert {(r.doc_id, r.epoch) for r in got.collect()} == brute_mix(rows, plan)
    assert got.columns == ["doc_id", "d", "lang", "source", "n", "domain", "tokens", "epoch"]


def test_mixing_edges(spark, odd, none):
    got = mixing.mix(odd)
    assert set(odd.columns) - {"epoch"} < set(got.columns) and got.where("text is null or trim(text) = ''").count() == 0
    assert mixing.mix(none).count() == 0


def test_chat_round_trip(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    make = chat.Formatter()
    piece = st.one_of(st.sampled_from([*make.template.controls(), "\\", "<", "[", "<\\/s>", "[\\\\INST]", "<s", "/s>"]), st.text(max_size=3))
    text = st.lists(piece, max_size=6).map("".join)
    role = st.one_of(st.sampled_from(["system", "user", "assistant", ""]), text)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.tuples(role, text), max_size=5))
    def check(turns):
        assert make.read("".join(s for s, _ in make.segments(turns))) == turns
        assert [make.unescape(s) for s, loss in make.segments(turns) if loss] == [t for r, t in turns if r == "assistant"]

    check()


def test_chat_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (2, 0, "assistant", "x"), (3, 1, None, "y"), (3, 0, "tool", "</s>"), (None, None, "user", "u"), (None, 1, "user", "v"), (4, 0, "user", "q"), (4, 0, "user", "q")]
    d = materialise(spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, rows int"))
    out = chat.read_back(chat.format_chats(d)).collect()
    got = {r.conv_id: r for r in out}
    assert [r.n_turns for r in out if r.conv_id is None] == [1, 1]  # rows without an id stay apart
    long = spark.createDataFrame([(1, 0, "user", "</s>" * 50_000), (1, 1, "assistant", "[INST] " * 50_000)], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(long)).first().loss_chars == 350_000
    assert got[1].valid and got[1].n_turns == 2 and got[1].loss_chars == 0
    assert (got[2].valid, got[2].bad_turn) == (False, 0) and (got[None].valid, got[None].bad_turn) == (False, 1)
    assert got[3].n_turns == 2 and (got[4].n_turns, got[4].bad_turn) == (2, 1)
    assert chat.read_back(chat.format_chats(d.limit(0))).count() == 0


def test_secret_spans_and_ledger(spark):
    import re

    texts = ["token = 'abc123xyz' AKIA" + "A" * 16 + " é password:hunter2", None, "", "secret=token : abcdefg", "aa " + "0123456789abcdef" * 2 + " AKIAAKIA" + "B" * 11, "-----BEGIN RSA PRIVATE KEY-----"]
    texts += [texts[0]] * 3 + ["api_key=\"x.y-z/1\" APIKEY: 12345 Secret=123456", "x" * 50_000 + " token=abcdef"]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "path long, text string, blob int")
    ledger = materialise(secrets.scan(d))
    assert ledger.count() == len({t or "" for t in texts}) * len(secrets.RULES)
    got = {r.path: [(s.rule, s.start, s.end) for s in r.found] for r in secrets.findings(d, ledger).collect()}
    for i, t in enumerate(texts):
        want = []
        for k, rule in enumerate(secrets.RULES):
            p = rule.pattern.replace("}+", "}")
            want += [(m.start(), k, rule.name, m.end()) for m in re.finditer(p, t or "", re.ASCII) if len(m[rule.group]) >= rule.least]
        assert got[i] == [(n, s, e) for s, _, n, e in sorted(want)]
    assert secrets.scan(d, ledger).count() == 0
    newer = (secrets.Rule("assign", 2, secrets.RULES[0].pattern, 2, 3), *secrets.RULES[1:])
    again = secrets.scan(d.unionByName(spark.createDataFrame([(99, "new token=abcdef", 1)], d.schema)), ledger, newer)
    assert {(r.rule, r.version): r["count"] for r in again.groupBy("rule", "version").count().collect()}[("assign", 2)] == len({t or "" for t in texts}) + 1
    assert again.where("rule = 'hex'").count() == 1
    assert secrets.scan(d.limit(0)).count() == 0


def brute_substrings(rows, length):
    texts = sorted((i, (t or "").encode().split()) for i, t in rows)
    out = {}
    for i, ws in texts:
        seen = {tuple(v[k : k + length]) for j, v in texts if j < i for k in range(len(v) - length + 1)}
        gone = {k + x for k in range(len(ws) - length + 1) if tuple(ws[k : k + length]) in seen for x in range(length)}
        out[i] = (len(ws), len(gone), " ".join(w.decode() for k, w in enumerate(ws) if k not in gone))
    return out


@pytest.mark.parametrize("cap", [1000, 5, 1])
def test_substring_dedup_matches_brute_force(spark, cap):
    rng = random.Random(cap)
    parts = [[rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(5, 40))] for _ in range(12)]
    rows = []
    for k in range(60):
        words = [w for _ in range(rng.randint(0, 5)) for w in rng.choice(parts)[rng.randint(0, 3) :]]
        if k % 3 == 0:
            words = words + [f"u{k}"] * rng.randint(0, 3) + words[:30]
        rows.append((k, " ".join(words)))
    rows += [(60, None), (61, ""), (62, "same " * 200), (63, "same " * 150)]
    d = docs(spark, [(*r, None, None) for r in rows])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.substring_dedup(d, length=12, gram=4, shard=cap).collect()}
    assert got == brute_substrings(rows, 12)
    assert any(v[1] for v in got.values())


def test_substring_dedup_edges(spark, odd, none):
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect()]
    assert len(got) == odd.count() and (6, 80, 0) in got and (7, 80, 80) in got and (None, 80, 80) in got and (1, 0, 0) in got
    assert (5, 30_001, 30_000) in got and (8, 82, 80) in got
    assert substring_dedup.substring_dedup(none).count() == 0


def test_automaton_matches():
    rng = random.Random(1)
    for _ in range(200):
        a = [[rng.choice("abc") for _ in range(rng.randint(0, 15))] for _ in range(3)]
        q = [rng.choice("abcd") for _ in range(15)]
        auto = substring_dedup.Automaton()
        for x in a:
            auto.add(x)
        have = {tuple(x[i:j]) for x in a for i in range(len(x)) for j in range(i + 3, len(x) + 1)}
        want = {k for i in range(len(q)) for j in range(i + 3, len(q) + 1) if tuple(q[i:j]) in have for k in range(i, j)}
        assert {k for s, e in auto.matches(q, 3) for k in range(s, e)} == want


def classifier_rows(spark, n=240):
    rng = random.Random(5)
    good, bad = ["house", "river", "stone", "green", "light"], ["###", "%%%", "zzz"]
    rows, labels = [], []
    for k in range(n):
        y = k % 2
        rows.append((k, " ".join(rng.choice(good if y else good[:2] + bad) for _ in range(40)), "en" if y else "fr", "s"))
        labels.append((k, y, 1 - y))
    return docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark, odd, none):
    d, labels = classifier_rows(spark)
    small = quality.Shape(buckets=1 << 12, dim=8, grams=(2, 3), lower=False, pairs=True)
    q = quality.fit(d, labels, F.col("doc_id") % 3 > 0, shape=small)
    out = {r.doc_id: r.score for r in quality.scores(d, q).collect()}
    assert all((out[k] >= 0.5) == (k % 2 == 1) for k in range(0, 240, 3))
    assert quality.keep_good(d, q).columns == d.columns and quality.keep_good(d, q).count() == 120
    t = toxicity.fit(d, labels, F.col("doc_id") % 3 > 0)
    out = {r.doc_id: r.score for r in toxicity.scores(d, t).collect()}
    assert all((out[k] >= 0.5) == (k % 2 == 0) for k in range(0, 240, 3))
    lang = langid.fit(d, F.col("doc_id") % 3 > 0, shape=langid.Shape(buckets=1 << 12, dim=8, grams=(2, 3)))
    out = {r.doc_id: r.lang_pred for r in langid.identify(d, lang).collect()}
    assert all(out[k] == ("en" if k % 2 else "fr") for k in range(0, 240, 3))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, lang).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[9][0] in ("en", "fr")
    for scored in (quality.scores(odd, q), toxicity.scores(odd, t)):
        assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == odd.count()
    assert quality.scores(none, q).count() == toxicity.scores(none, t).count() == langid.identify(none, lang).count() == 0


def test_classifiers_without_labels(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(4, 1, 1), (None, 0, 0), (5, None, None)], labels.schema)
    assert {r.score for r in quality.scores(odd, quality.fit(odd, labels)).collect()} == {0.5}
    assert {r.score for r in quality.scores(odd, quality.fit(odd, one)).collect()} == {1.0}
    assert {r.score for r in toxicity.scores(odd, toxicity.fit(odd, labels)).collect()} == {0.0}
    lang = langid.fit(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, lang).collect()} == {"und"}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_exact_dedup_salts_large_classes_on_both_ways(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HOT", broadcast)
    rows = spark.range(0, 3000, 1, 6).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("own "), F.col("id").cast("string"))).alias("text"))
    out = exact_dedup.decisions(rows, salts=6, hot=100)
    assert sum(r.kept for r in out.collect()) == 1001
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "task" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        seen = exact_dedup.decisions(rows, salts=6, hot=100)
        joined = seen.where("group_size > 100").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(r["count"] for r in joined) == 2000
