import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from quire import cli
from quire.operators import page_run
from quire.plans import details, engine, views
from quire.sources import documents, pages


def test_names(spark):
    df = spark.createDataFrame([("None", "weight700Bold"), ("Degrees270", "350"), ("other", "bold"), (None, None)], "r string, w string")
    rows = df.select(page_run.rotation_degrees(F.col("r")), page_run.font_weight(F.col("w"))).collect()
    assert [tuple(r) for r in rows] == [(0, 700), (270, 350), (None, None), (None, None)]


def test_native_asset():
    assert pages.native_asset("linux", "x86_64")[2] == "libpdfium.so" and pages.native_asset("windows", "x86_64")[0].endswith(".zip")
    with pytest.raises(ValueError):
        pages.native_asset("plan9", "mips")


def test_reader_errors_are_rows(spark):
    class Broken(details._LineReader):
        def page(self, index):
            if index == 1:
                raise RuntimeError("damaged")
            return details._LineReader.page(self, index)

    text = "\n".join(f"line {k}" for k in range(20))
    files = spark.createDataFrame([(1, text.encode()), (2, b""), (3, None)], "doc_id long, content binary")
    read = pages.read_pages(files, lambda: Broken, dpi=7.2)
    wrong = sorted((r["doc_id"], r["page_idx"], r["error"]) for r in pages.open_errors(read).collect() if r["page_idx"] is not None)
    assert wrong == [(1, 1, "page 1 of 3: damaged")]
    assert {r["doc_id"] for r in pages.open_errors(read).where("page_idx is null").collect()} == {2, 3}
    good = read.where("doc_id = 1 and error is null").collect()
    assert sorted(r["page_idx"] for r in good) == [0, 2] and all(len(r["pixels"]) == 3 * r["width_px"] * r["height_px"] == 3 * 61 * 79 for r in good)
    assert pages.raw_characters(read).where("weight = 700").count() == 8 + 4


def test_absent_stages(spark, sf_dir):
    dets = views.regions(spark, sf_dir).select("doc_id", "page_idx", "idx", "order", "label", "bbox")

    def missing(_):
        raise FileNotFoundError("no weights")

    with pytest.warns(UserWarning, match="stage formulas is absent: no weights"):
        backend = engine.PageRunBackend(lambda _: dets, {"formulas": missing, "native": lambda _: dets.select(*page_run.KEY, F.lit("t").alias("text"))}, 1.0)
        blocks = backend.analyze(dets, documents.ParseOptions())
    assert blocks.where("kind = 'text' and not discarded").count() > 0
    assert blocks.where("kind = 'equation' and latex <> ''").count() == 0
    assert page_run.recognised(dets, page_run.Stages()).where("html is not null or latex is not null or size(text_lines) > 0").count() == 0
    assert page_run.recognised(dets.limit(0), page_run.Stages()).count() == 0


def test_options_act(spark, sf_dir):
    regions = views.regions(spark, sf_dir)
    backend = engine.PipelineBackend(lambda _: regions)
    every, bare = (backend.analyze(regions, documents.ParseOptions(formula=f, table=f)) for f in (True, False))
    assert every.where("kind = 'table' and html <> ''").count() > 0 and bare.where("kind = 'table' and html <> ''").count() == 0
    assert every.where("kind = 'equation' and latex <> ''").count() > 0 and bare.where("kind = 'equation' and latex <> ''").count() == 0
    assert bare.count() == every.count()


def test_pages_on_the_command_line(spark, sf_dir, tmp_path):
    base = views.regions(spark, sf_dir)
    base.select(*page_run.KEY, "order", "label", "bbox").write.parquet(str(tmp_path / "detections.parquet"))
    base.select(*page_run.KEY, F.lit("words").alias("text")).write.parquet(str(tmp_path / "native.parquet"))
    views.pages(spark, sf_dir).write.parquet(str(tmp_path / "pages.parquet"))
    with pytest.warns(UserWarning):
        blocks = cli.run(spark, [str(tmp_path), "-o", str(tmp_path / "out"), "-b", "pages", "--dpi", "72", "--no-table"])
    assert blocks.where("kind = 'text' and not discarded").count() > 0
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["x", "-o", "y", "--device", "gpu"])


@pytest.mark.parametrize("hidden", ["quire.llm", "corpus_pipeline", "xxhash"])
def test_entry_point_without_optional_parts(hidden):
    code = f"import sys; sys.modules['{hidden}'] = None; import __spark_entry__ as e; q = e.queries(); assert 'markdown_documents' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0])
