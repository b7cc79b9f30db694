import json
import random

import pytest
import tablewright as tw
from tablewright.cli import main
from tablewright.sources.tables import read_csv, read_table, write_csv, write_parquet
from tablewright.streaming.apply import prepared_stream, write_stream


@pytest.fixture(scope="module")
def csv(tmp_path_factory):
    rnd = random.Random(2)
    path = tmp_path_factory.mktemp("csv") / "houses.csv"
    lines = ["sqft,rooms,kind,built,note,price"]
    for i in range(100):
        lines.append(f'{rnd.gauss(150, 30):.2f},{rnd.randrange(1, 6)},{rnd.choice(["flat", "NA", "house"])},2020-01-{1 + i % 28:02d},"a, ""quoted"" note",{rnd.gauss(300, 50):.1f}')
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_csv_types_and_missing_values(spark, csv, tmp_path):
    df = read_csv(spark, csv)
    assert dict(df.dtypes) == {"sqft": "double", "rooms": "bigint", "kind": "string", "built": "string", "note": "string", "price": "double"}
    assert df.where("kind = 'NA'").count() == 0 and df.where("kind IS NULL").count() > 0
    assert df.first().note == 'a, "quoted" note'
    write_csv(df, str(tmp_path / "o.csv"))
    write_parquet(df, str(tmp_path / "o"))
    assert read_table(spark, str(tmp_path / "o")).count() == read_table(spark, str(tmp_path / "o.csv")).count() == 100


def test_prepare_command(spark, csv, tmp_path, capsys):
    pdf = str(tmp_path / "r.pdf")
    args = ["prepare", csv, "--target", "price", "--task", "regression", "--output-dir", str(tmp_path), "--interactions", "--interaction-types", "ratio"]
    assert main([*args, "--column-type", "rooms:NUMERIC_FEATURE", "--save-pdf", pdf, "--verbose"]) == 0
    said = capsys.readouterr().out
    assert "Success! Resulting shape:" in said and "Wrote pipeline:" in said
    assert any("_div_" in c for c in (tmp_path / "houses_prepared.csv").read_text().split("\n")[0].split(","))
    assert json.loads((tmp_path / "houses_report.json").read_text())["target"] == "price"
    model = tw.PrepModel.load(str(tmp_path / "houses_pipeline.json"))
    assert model.transform(read_csv(spark, csv)).count() == 100


@pytest.mark.parametrize(
    "more",
    [
        ["--preset", "slow"], ["--drop-threshold", "2"], ["--cardinality-threshold", "0"], ["--column-type", "rooms"], ["--cluster-k", "x"],
        ["--interaction-types", "sum"],
    ],
)
def test_refusals(spark, csv, tmp_path, more, capsys):
    assert main(["prepare", csv, "--target", "price", "--task", "regression", "--output-dir", str(tmp_path), *more]) == 1
    assert capsys.readouterr().err.startswith("Error")


def test_bad_files(spark, csv, tmp_path):
    assert main(["prepare", str(tmp_path / "none.csv"), "--target", "y"]) == 1
    (tmp_path / "x.txt").write_text("a,b\n1,2\n")
    assert main(["prepare", str(tmp_path / "x.txt"), "--target", "a"]) == 1
    (tmp_path / "e.csv").write_text("a,b\n1,\n2,\n")
    assert main(["prepare", str(tmp_path / "e.csv"), "--target", "b"]) == 1
    assert main(["prepare", csv, "--target", "nope"]) == 1


def test_compare_command(spark, csv, tmp_path):
    out = str(tmp_path / "c.pdf")
    args = ["compare", csv, csv, "--target-a", "price", "--target-b", "sqft", "--task-a", "regression", "--task-b", "regression", "--output-pdf", out]
    assert main(args) == 0 and open(out, "rb").read(4) == b"%PDF"


def test_a_stream_is_prepared_like_a_table(spark, tmp_path):
    df = spark.range(200).selectExpr("id % 4 AS k", "concat('c', id % 30) AS city", "id * 0.5 AS x", "id % 2 AS y")
    model = tw.prepare(df, "y").pipeline
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = write_stream(model, stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    want = model.transform(df)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 200 and got.select(*want.columns).exceptAll(want).count() == 0
    with pytest.raises(ValueError):
        prepared_stream(model, df)
