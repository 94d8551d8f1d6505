"""Each stage of the pipeline against brute force on what the stage before kept."""

import re
from collections import Counter, defaultdict

import public_tokenizers
from test_text_operators import brute_links, brute_targets, check_packing
from tokenizers import Tokenizer

import corpus_pipeline
from galegrid.llm import queries
from galegrid.llm.common import kept, read_documents

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    docs = {"documents": read_documents(spark, sf_dir)}
    before = docs["documents"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "ngram_join", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        docs[name] = kept(stage(spark, before, sf_dir))
        before = docs[name]
        if name != "packing":
            assert before.columns == docs["documents"].columns
    rows = {name: df.collect() for name, df in docs.items()}
    ids = lambda name: sorted(r.doc_id for r in rows[name])

    good = {r.doc_id for r in queries.op3_quality(spark, sf_dir).collect() if r.predicted}
    assert ids("quality") == sorted(good)

    groups = defaultdict(list)
    for r in rows["quality"]:
        groups["".join(c for c in r.text or "" if c not in " \t\n\x0b\f\r")].append((-len(r.text or ""), r.doc_id))
    assert ids("exact_dedup") == sorted(min(g)[1] for g in groups.values())

    texts = {r.doc_id: r.text or "" for r in rows["exact_dedup"]}
    _, root = brute_links(texts)
    assert ids("ngram_join") == sorted(set(root.values()))

    count = lambda t: len(WORDS.findall(t or ""))
    sizes, taken = defaultdict(int), Counter()
    for r in rows["ngram_join"]:
        sizes[r.source] += count(r.text)
    for r in rows["mixing"]:
        taken[r.source] += count(r.text)
    assert all(abs(taken[s] - t) <= 1 for s, t in brute_targets(sizes).items())
    assert max(Counter(r.doc_id for r in rows["mixing"]).values()) <= 3

    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY))
    want = Counter()
    for r in rows["mixing"]:
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = Counter()
    for r in rows["packing"]:
        packed[r.doc_id] += r.length
        assert len(r.ids) == r.length
    assert packed == want
    once = {d for d, n in Counter(r.doc_id for r in rows["mixing"]).items() if n == 1}
    check_packing(rows["packing"], {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 0] for r in rows["mixing"] if r.doc_id in once})


def test_stages_take_odd_rows_and_none(spark, odd, none, sf_dir, tmp_path):
    """Without labels nothing is rejected, so each later stage's rows follow from the table: one of each equal text, one of each class."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    docs, counts = odd, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, str(tmp_path)))
        counts[name] = docs.count()
    texts = [r.text or "" for r in odd.collect()]
    assert counts["quality"] == len(texts) and counts["exact_dedup"] == len({re.sub(r"[\x20\x09-\x0D]+", "", t) for t in texts})
    # of the rest, rows 6, 7 and the one with a null id are near copies
    assert counts["ngram_join"] == counts["exact_dedup"] - 2
    assert counts["mixing"] > 0 and counts["packing"] >= counts["mixing"]
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        docs = kept(stage(spark, docs, sf_dir))
        assert docs.count() == 0, name
