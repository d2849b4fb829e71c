"""The pipeline, stage by stage, against plain versions of each stage's decisions."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from readprep.llm import quality

from .test_packing import check
from .test_texts import brute_dedup, brute_groups, check_mix, words


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / str(k)))
        outs.append((docs.collect(), spark.read.parquet(str(tmp_path / str(k)))))
        docs = outs[-1][1]
    assert all(df.columns == columns for _, df in outs[:-1])

    before, good = outs[0]
    score = {r["doc_id"]: r["predicted"] for r in quality.op6(spark, small).collect()}
    assert sorted(map(tuple, good.collect())) == sorted(tuple(r) for r in before if score[r["doc_id"]])

    before, kept = outs[1]
    group = brute_groups([(r["doc_id"], r["text"]) for r in before])
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for i, r in enumerate(before) if group[i] == r["doc_id"])

    before, cut = outs[2]
    before = sorted(before, key=lambda r: r["doc_id"])
    want = brute_dedup([r["text"].encode() for r in before])
    got = {r["doc_id"]: r for r in cut.collect()}
    for r, (removed, _, text) in zip(before, want, strict=True):
        text = text.decode("utf-8", "ignore") if removed else r["text"]
        assert got[r["doc_id"]].asDict() == r.asDict() | {"text": text, "n_chars": len(text)}

    before, mixed = outs[3]
    rows = mixed.collect()
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + len(words(r["text"]))
    sizes = {}
    for r in before:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    from readprep.llm import mixing

    targets = {r["source"]: r["target"] for r in mixing.mix(cut).select("_row.source", "target").distinct().collect()}
    check_mix([{"source": r["source"], "size": len(words(r["text"])), "source_size": sizes[r["source"]], "target": targets[r["source"]], "taken": taken.get(r["doc_id"], 0)} for r in before], before)
    for s, t in targets.items():
        assert abs(sum(taken.get(r["doc_id"], 0) for r in before if r["source"] == s) - t) <= 1

    before, packed = outs[4]
    check(packed.collect(), [(r["doc_id"], r["text"]) for r in before])


def test_stages_take_odd_documents(spark, odd, none, tmp_path):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, none):
        for k, (_, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            n = out.count()
            assert n or docs is none
            if k < len(P.STAGES) - 1:
                assert out.columns == docs.columns


def test_run_and_registration(spark, small):
    assert P.run(spark, small).agg(F.sum("length")).first()[0] > 0
    assert entry.queries()["pipeline"].__wrapped__ is P.run and [n for n, _ in P.STAGES][0] == "quality_classifier"
    assert {f"op{n}" for n in range(1, 11)} <= {q.partition("_")[0] for q in entry.queries()}


def test_entry_without_the_subpackage(tmp_path):
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['readprep.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.oracle_sql()) > 40)"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=Path(P.__file__).parent, check=True)
    assert out.stdout.split() == ["0", "True"]


@pytest.mark.parametrize("name", ["readprep/llm/minhash.py", "readprep/llm/suffix_dedup.py", "readprep/llm/common.py"])
def test_no_local_checkpoints(name):
    from pathlib import Path

    assert "localCheckpoint" not in (Path(P.__file__).parent / name).read_text()
