import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.session import written
from test_line_dedup import brute as brute_lines
from test_minhash import brute as brute_near
from test_packing import check as check_packed
from test_suffix_dedup import brute as brute_suffix

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output rows of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), result.collect(), result.columns)
        docs = result
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "suffix_dedup",
                                                     "packing"]
    for name in list(stages)[:-1]:
        assert stages[name][2] == ["doc_id", "text", "lang", "source", "n_chars"]
        assert all(r.n_chars == len(r.text) for r in stages[name][1])


def test_toxic_documents_go(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r.doc_id: r.text for r in rows} for rows in stages["toxicity"][:2])
    assert after.items() <= before.items()
    clean = [i for i in before if labels.get(i) == 0]
    assert np.mean([i in after for i in clean]) > 0.97


def test_line_stage(stages):
    before, after, _ = stages["line_dedup"]
    want = brute_lines([r.text for r in before], [r.doc_id for r in before])
    kept = {k: text for (k, _), (text, _, gone) in want.items() if not gone or text.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in after} == kept


def test_near_duplicate_stage(stages):
    before, after, _ = stages["near_duplicates"]
    want = {r[0] for r in brute_near([r.text for r in before], [r.doc_id for r in before], 5) if r[3]}
    assert {r.doc_id for r in after} == want
    assert {(r.doc_id, r.text) for r in after} <= {(r.doc_id, r.text) for r in before}


def test_near_duplicate_stage_goes_by_rows(spark, make_docs):
    words = [f"w{i}" for i in range(200)]
    text = lambda a, *more: " ".join([*words[a:a + 40], *more])
    texts = [(1, text(0)), (None, text(0, "x")),              # a near-copy without id, of a group with one
             (None, "a clean text of its own without any id"), (None, "and a second one that is unlike the first"),
             (2, text(40)), (3, text(40, "y")), (3, "a unique text that shares its id with a near copy"),
             (4, text(80)), (4, text(80)), (4, text(80)), (5, text(80, "z")),  # repeated rows and a near-copy
             (None, text(120)), (None, text(120)), (None, text(120, "u")),     # ids are all null
             (6, text(150)), (6, text(150, "v")),                              # near-copies alike in id
             (7, ""), (7, ""), (None, None), (None, " ")]
    docs = make_docs([t for _, t in texts], [i for i, _ in texts], parts=3)
    sets = [{tuple(t.split()[i:i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.split() else set()
            for _, t in texts]
    top = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and len(a & b) >= 0.8 * len(a | b):
                    top[i] = top[j] = min(top[i], top[j])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()]
    groups = [[texts[i] for i in range(len(texts)) if top[i] == g] for g in sorted(set(top))]
    assert len(got) == len(groups)
    for group in groups:
        least = min((i for i, _ in group if i is not None), default=None)
        assert any((i, t) in got for i, t in group if i == least)
        if (group[0][1] or "").split():  # rows without words are a group each
            assert sum(got.count(row) for row in set(group)) == 1


def test_suffix_stage(stages):
    before, after, _ = stages["suffix_dedup"]
    got = {r.doc_id: r.text for r in after}
    for r, (_, removed, spans, _, kept) in zip(before, brute_suffix([r.text for r in before], 200)):
        if removed and not kept:
            assert len(got.get(r.doc_id, "").encode()) <= 4 * spans
        else:
            assert len(kept) <= len(got[r.doc_id].encode()) <= len(kept) + 4 * spans


def test_packing_stage(stages):
    before, after, _ = stages["packing"]
    n, least = check_packed(after, [r.text for r in before], [r.doc_id for r in before], 4096)
    assert n <= least + 1


def test_run_is_the_stages_in_order(spark, stages):
    place = lambda rows: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert place(corpus_pipeline.run(spark, SF).collect()) == place(stages["packing"][1])


def test_odd_rows_pass_all_stages(spark, make_docs, edge_texts, folder):
    ids = [None if i in (1, 4) else i for i in range(len(edge_texts))]
    docs = make_docs(edge_texts, ids, parts=2)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "odd")
    assert docs.count() > 0
    docs = make_docs(["x"]).where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), "none")
    assert docs.count() == 0


def test_library_stands_without_these_parts(tmp_path):
    import subprocess
    import sys
    repo = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    copy = tmp_path / "repo"
    shutil.copytree(repo, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


INNER = ["_key", "_mark", "_later", "_text", "_lo", "_hi", "_w", "_l", "_s", "_number", "_bucket", "_row", "_n", "_before",
         "_id", "_y", "key", "mark", "n", "cohort", "d2", "r", "t"]


def test_inner_names_as_input_columns(spark, make_docs):
    """Columns called like any inner column pass through every operator that keeps columns."""
    from marquee.llm import line_dedup, packing, quality, sharding, suffix_dedup, toxicity
    from marquee.llm.queries import tokenizer_file
    line = "this line is here and there and everywhere it seems\nand so is this one\nand a third one too\n"
    texts = [line * 3 + "one", line * 2 + "two", None, "", "short"]
    docs = make_docs(texts).drop("key", "part")
    for i, c in enumerate(INNER):
        docs = docs.withColumn(c, F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")))
    want = sorted((r.doc_id, *[f"{i}:{r.doc_id}" for i in range(len(INNER))]) for r in docs.select("doc_id").collect())
    model = toxicity.fit([], [], 0.5)
    pieces = packing.pieces(make_docs(texts), tokenizer_file("word_bpe_49k.json"), with_ids=False)
    pieces = pieces.select("*", *[F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")).alias(c)
                                  for i, c in enumerate(INNER)])
    for out in (line_dedup.remove_repeats(docs), suffix_dedup.remove_repeats(docs), toxicity.score(docs, model),
                quality.quality(docs), packing.pack(pieces), sharding.assign(docs, ["a", "b"])):
        assert sorted(tuple(r) for r in out.select("doc_id", *INNER).collect()) == want
