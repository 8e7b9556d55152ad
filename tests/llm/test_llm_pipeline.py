"""The pipeline against a brute-force version of each of its decisions."""

import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from data import documents, labels, with_clashes  # noqa: E402
from test_llm_bpe import expected  # noqa: E402
from test_llm_lines import brute as without_repeats  # noqa: E402
from test_llm_mixing import n_words, targets  # noqa: E402
from test_llm_simhash import brute_components, plain  # noqa: E402

import corpus_pipeline as P  # noqa: E402
from kestrel.llm import mixing, toxicity  # noqa: E402


def test_stages_and_run(spark, sf_small, tmp_path):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.tokenizer_path())
    src = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs, kept = src, []
    for i, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, sf_small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append(docs.collect())
        assert i == len(P.STAGES) - 1 or docs.columns == src.columns
    reader = toxicity.fit(src, spark.read.parquet(f"{sf_small}/labels.parquet")).reader()
    rows = {r.doc_id: r for r in src.collect()}
    # toxicity
    clean = {i: r for i, r in rows.items() if reader.score(reader.marks(r.text or "")) < 0.7}
    assert sorted(map(tuple, kept[0])) == sorted(map(tuple, clean.values())) and len(clean) < len(rows)
    # line dedup
    lined = without_repeats([(i, r.text) for i, r in clean.items()])
    lined = {k[0]: v for k, v in lined.items()}
    assert {r.doc_id: r.text for r in kept[1]} == lined and all(r.n_chars == len(r.text) for r in kept[1])
    # one of each group of near copies
    ids = sorted(lined)
    root = brute_components([plain(lined[i]) for i in ids], ids, 2)
    stay = {i for i, c in zip(ids, root) if i == c}
    assert {r.doc_id: (r.text, r.source) for r in kept[2]} == {i: (lined[i], rows[i].source) for i in stay}
    # mixing
    sizes, got = defaultdict(int), defaultdict(int)
    for i in stay:
        sizes[rows[i].source] += n_words(lined[i])
    passes = defaultdict(list)
    for r in kept[3]:
        passes[r.doc_id].append(r.text)
        got[r.source] += n_words(r.text)
        assert r.n_chars == len(r.text)
    for s, t in targets(sizes).items():
        assert abs(got[s] - t) <= max(0.03 * t, mixing.BLOCK)
    for i, texts in passes.items():
        assert i in stay and len(texts) <= 2 and sum(map(n_words, texts)) <= 2 * n_words(lined[i]) and lined[i] in (
            texts if len(texts) == 2 else [lined[i]])
    # BPE
    want = sorted((r.doc_id, *expected(library, r.text)) for r in kept[3])
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in kept[4]) == want
    again = P.run(spark, sf_small).drop("ids").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in again) == want


def test_stages_on_edge_rows(spark, tmp_path):
    sf = tmp_path / "sf"
    labels(spark, [(11, 1, 1), (1, 1, 0)]).write.parquet(str(sf / "labels.parquet"))
    for docs in (with_clashes(documents(spark)), documents(spark, [])):
        for name, stage in P.STAGES:
            out = stage(spark, docs, str(sf))
            assert out.columns == docs.columns or name == "bpe"
            n = out.count()
            assert (n > 0) == (not docs.isEmpty())
