import pytest

pytest.importorskip("public_tokenizers")

from emberline.llm.queries import op1_mix_sources  # noqa: E402


def test_every_row_has_a_place(spark, tmp_path):
    rows = [(i % 40, "src0" if i % 3 else None, f"t{i}") for i in range(100)] + [(None, "src1", "x")] * 20
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op1_mix_sources(spark, str(tmp_path)).collect()
    assert sorted(str((r.doc_id, r.source)) for r in got) == sorted(str(r[:2]) for r in rows)
    assert len({(r.cycle, r.slot, r.offset) for r in got}) == len(rows)
