"""The pipeline against a plain version in Python, and the queries without SQL against brute force or held-out labels."""

import hashlib
import re

import pytest

import corpus_pipeline
from chipmeter.llm import mixing, quality, queries, simhash

from .test_near_copies import brute_kept
from .test_operators import brute_components, brute_mix, docs

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_plain_version(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scorer = quality.fit(table, labels, ~quality.held_out())
    all_rows = table.collect()
    rows = [r for r, s in zip(all_rows, scorer.score([r.text for r in all_rows])) if s >= 0.5]
    assert len(rows) < len(all_rows)

    best = {}
    for r in rows:
        k = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        if k not in best or (-len(r.text or ""), r.doc_id) < (-len(best[k].text or ""), best[k].doc_id):
            best[k] = r
    rows = list(best.values())

    kept = set(brute_kept(rows))  # five words, similarity 0.8
    rows = [r for r in rows if r.doc_id in kept]

    def words(t):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    windows = set()
    for t in bench:
        w = words(t)
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(w) for w in windows}
    rows = [r for r in rows if not any(tuple(w[i : i + n]) in windows for w in [words(r.text)] for n in sizes for i in range(len(w) - n + 1))]

    domain = ("web", "books", "forums", "news")
    leaves = [(r.doc_id, domain[int(re.search(r"\d+$", r.source)[0]) % 4], r.lang, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in rows]
    got = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.epoch) for r in got.collect()} == brute_mix(leaves, mixing.Plan())
    assert got.columns == [*table.columns, "domain", "tokens", "epoch"]


def test_stages_keep_the_columns_of_documents(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, SF)
        assert out.columns == table.columns and 0 < out.count() <= table.count()


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, name):
    """Empty tables, null ids and texts, ties, repeated rows and columns with clashing names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id = 1").first().text + " of its own"
    rows = [(1, None, "en", "src0"), (2, "", None, None), (3, plain, "en", "src1"), (3, plain, "en", "src1"), (None, plain, "en", "src1"), (4, plain + " ", "en", "src1"), (None, None, None, None)]
    rows += [(5, item, "en", "src2"), (6, item.upper(), "en", "src2"), (7, "one word " * 20_000, "de", "src3")]
    odd = docs(spark, rows)
    out = stage(spark, odd, SF)
    ids = sorted(str(r.doc_id) for r in out.collect())
    known = {(r.doc_id, r.text, r.source) for r in odd.collect()}
    assert all((r.doc_id, r.text, r.source) in known for r in out.collect())
    if name != "mixing":
        assert out.columns == odd.columns
    if name == "quality":  # decides by the text alone
        for same in (("1", "2"), ("3", "4"), ("3", "None")):
            assert len({i in ids for i in same if i != "None"}) == 1
        assert ids.count("3") in (0, 2)
    want = {"exact_dedup": [["2", "4", "5", "6", "7"], ["1", "4", "5", "6", "7"]], "near_dedup": [["1", "3", "5", "7"]], "decontamination": [["1", "2", "3", "3", "4", "7", "None", "None"]]}
    if name in want:
        assert ids in want[name]
    if name == "mixing":
        assert not {"1", "2"} & set(ids) and "None" not in [str(r.doc_id) for r in out.collect() if not r.text]
    assert stage(spark, docs(spark, []), SF).count() == 0


def test_simhash_query_matches_brute_force(spark):
    got = queries.QUERIES["op8_simhash_near_dedup"](spark, SF).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {i: simhash.fingerprint(t.encode()) & (2**64 - 1) for i, t in texts.items()}
    root = brute_components(set(fp.values()))
    first = {}
    for i, f in fp.items():
        first[root[f]] = min(i, first.get(root[f], i))
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{f:016x}", first[root[f]]) for i, f in fp.items()}


@pytest.mark.parametrize("name,right", [("op2_language_id", 0.97), ("op7_toxicity", 0.95), ("op10_quality", 0.95)])
def test_held_out_accuracy(spark, name, right):
    sf = "/root/testdata/sf0.01"
    out = queries.QUERIES[name](spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.count() == n
    key = {"op2_language_id": "lang", "op7_toxicity": "toxic", "op10_quality": "quality"}[name]
    truth = spark.read.parquet(f"{sf}/{'documents' if key == 'lang' else 'labels'}.parquet").select("doc_id", key)
    rows = out.where("held_out").join(truth, "doc_id").collect()
    guess = "lang_pred" if key == "lang" else "predicted"
    assert sum(r[guess] == r[key] for r in rows) >= right * len(rows)
    if key == "toxic":
        toxic = [r for r in rows if r.toxic == 1]
        assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 5
    assert all(0 <= r.score <= 1 for r in rows)


def test_chat_query_adds_the_probe(spark):
    rows = {r.conv_id: r for r in queries.QUERIES["op5_chat_format"](spark, SF).collect()}
    text = "</s>[INST] ok [/INST]"
    assert rows[-1].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert rows[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and rows[-1].loss_chars == len(text)
