"""Inferred schemas and tails of files."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from foretally.sources import inference, tail

CELLS = {"boolean": ["True", "false", "NA"], "bigint": ["1", "-7", "+3", " 12 ", "007", ""], "double": ["1.5", "2", "1e-3", "inf", "nan", "9223372036854775808"], "date": ["2024-02-29", "NaN", "1999-12-31"], "timestamp_ntz": ["2024-01-01 10:00", "2024-01-01", "2024-01-01T10:00:01.5"], "string": ["x", "1.5", "2023-02-29"]}


@pytest.mark.parametrize("kind", CELLS)
def test_narrowest_type(spark, kind):
    df = spark.createDataFrame([(x,) for x in CELLS[kind]], "a string")
    for parts in (1, 4):
        r = inference.kinds(df.repartition(parts)).first()
        assert (r["kind"], r["n"]) == (kind, len(CELLS[kind]))
    out = inference.typed(df)
    assert out.dtypes == [("a", kind)]
    assert out.where("a is null").count() == sum(x in inference.MISSING for x in CELLS[kind])


def test_types_meet_in_any_order(spark):
    """The type of two columns under each other is the least that holds both, whichever comes first."""
    got = {}
    for a, b in itertools.product(CELLS, CELLS):
        got[a, b] = CELLS[a] + CELLS[b]
    df = spark.createDataFrame([(i, x) for i, rows in enumerate(got.values()) for x in rows], "i int, x string")
    found = {r["i"]: r["kind"] for r in df.groupBy("i").agg(inference.narrowest(F.bit_and(inference.holders(F.col("x")))).alias("kind")).collect()}
    found = dict(zip(got, (found[i] for i in range(len(got))), strict=True))
    assert all(found[a, b] == found[b, a] for a, b in found) and all(found[a, a] == a for a in CELLS)
    assert found["bigint", "double"] == "double" and found["date", "timestamp_ntz"] == "timestamp_ntz" and found["boolean", "bigint"] == "string" and found["date", "double"] == "string"


def test_csv_by_all_rows(spark, tmp_path):
    """The only value that isn't whole is the last of many files; the schema is the same for one file and for many."""
    head, lines = "﻿a,b,c,d,e\n", [f'{i},{i},"x, ""{i}""",2024-01-{i % 28 + 1:02d},\n' for i in range(3000)] + ["1,0.5,y,2024-02-01,\n"]
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    (tmp_path / "one" / "x.csv").write_text(head + "".join(lines))
    for k in range(31):
        (tmp_path / "many" / f"{k:02d}.csv").write_text(head + "".join(lines[k * 100 : k * 100 + 100]))
    one, many = (inference.csv(spark, str(tmp_path / d)) for d in ("one", "many"))
    assert one.dtypes == many.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "date"), ("e", "double")]
    assert sorted(one.collect()) == sorted(many.collect()) and one.where("c = 'x, \"5\"'").count() == 1 and one.where("e is null").count() == 3001
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "x.csv").write_text("a,b\n")
    assert inference.csv(spark, str(tmp_path / "empty")).dtypes == [("a", "double"), ("b", "double")]


def test_tails_of_files(spark, tmp_path):
    r = random.Random(0)
    texts = {"empty.txt": b"", "one.txt": b"no end", "few.txt": "a\nb\n".encode(), "blank.txt": b"\n\n\n", "cut.txt": ("é€\U0001f600" * 3000 + "\n" + "ü" * 5000 + "\nlast\n").encode(), "bad.txt": b"x\n\xff\xfe\ny"}
    for k in range(6):
        texts[f"r{k}.txt"] = "\n".join("é" * r.randint(0, 300) for _ in range(r.randint(1, 400))).encode() + b"\n" * (k % 2)
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "other.log").write_text("no")
    big = tmp_path / "big.txt"
    with big.open("wb") as f:
        for i in range(400_000):
            f.write(b"line %d of a large file\n" % i)
    for lines in (1, 3, 40):
        got = {x["file_name"]: x for x in tail.tails(spark, str(tmp_path), lines, ".txt").collect()}
        assert set(got) == {*texts, "big.txt"}
        for name, data in texts.items():
            assert got[name]["tail"] == "\n".join(data.decode("utf-8", "replace").splitlines()[-lines:]), (name, lines)
        assert got["big.txt"]["tail"].splitlines() == [f"line {i} of a large file" for i in range(400_000 - lines, 400_000)]
        assert got["big.txt"]["n_bytes"] > 8_000_000 and got["big.txt"]["n_read"] <= 4096
    assert tail.tails(spark, "file://" + str(big), 2).first()["tail"].count("\n") == 1
    (tmp_path / "none").mkdir()
    assert tail.tails(spark, str(tmp_path / "none")).count() == 0


def test_templates_and_artifacts(spark, tmp_path):
    from foretally.sources import tables

    for n in (1, 4):
        (tmp_path / "prompts" / f"scenario{n}_x").mkdir(parents=True)
        for turn, _, name in tables.TURN_FILES:
            (tmp_path / "prompts" / f"scenario{n}_x" / name).write_text(f"Turn {turn} of <PRIMARY_TARGET_COLUMN_NAME>, <PRIMARY_TARGET_COLUMN_NAME>\nModel <MODEL_NAME> with <HYPERPARAMETERS>\nForecast horizon: H (>0)\nBlock size: B (>0)\n")
        (tmp_path / "prompts" / f"scenario{n}_x" / "system_instruction.txt").write_text("no turn")
    t = tables.templates(spark, str(tmp_path / "prompts"))
    assert sorted((r["scenario"], r["turn"], r["label"]) for r in t.collect()) == sorted((f"S{n}", i, k) for n in (1, 4) for i, k, _ in tables.TURN_FILES)
    setups = spark.createDataFrame([("S4", "d", "OT", "ETS", "{'a': 1}", 12, "a,b\n1,2\n"), ("S2", "d", "OT", "ETS", "", 1, "")], "scenario string, dataset string, target string, model string, hyperparameters string, horizon int, csv string")
    got = {r["turn"]: r["content"] for r in tables.prompts(t, setups).collect()}
    body = "Turn {} of OT, OT\nModel ETS with {{'a': 1}}\nForecast horizon: 12 (>0)\nBlock size: 12 (>0)\n"
    assert got[1] == body.format(1) and got[0].endswith("RAW CSV START\na,b\n1,2\nRAW CSV END") and got[3].startswith(body.format(3)) and "input.csv" in got[3] and len(got) == 4
    rows = [("f1", "scripts-output/f1.py", "import x\nprint(1)\n", "", " raw "), ("f2", "", "", "raw-forecasts/f2.json", " [1, 2]\n"), ("f3", "", "", "", "nothing")]
    records = spark.createDataFrame(rows, "file_id string, script_file string, t3_script_content string, raw_file string, t3_raw_response string")
    for _ in range(2):
        tables.write_artifacts(records, str(tmp_path / "out"))
    assert sorted(map(tuple, tables.artifacts(spark, str(tmp_path / "out")).collect())) == [("raw-forecasts", "f2.json", "[1, 2]"), ("scripts-output", "f1.py", "import x\nprint(1)\n")]
