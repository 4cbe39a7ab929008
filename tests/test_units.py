"""Rules on literal rows, and properties."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foretally.functions import numeric as N
from foretally.functions import text as T
from foretally.operators import forecast, ledger, metrics, protocol, records, series, stats, summary, taxonomy, transcripts
from foretally.sources import tables


def values(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr).collect()]


def test_numbers(spark):
    x = [("1.5",), ("nan",), ("inf",), ("x",), (None,), ("-2",)]
    assert values(spark, N.number(F.col("x")), x, "x string") == [1.5, None, None, None, None, -2.0]


def test_erfc(spark):
    xs = [0.0, 0.2, 0.46, 0.47, 1.0, 2.5, 3.99, 4.01, 6.0, 10.0]
    for x, got in zip(xs, values(spark, N.erfc(F.col("x")), [(x,) for x in xs], "x double"), strict=True):
        assert got == pytest.approx(math.erfc(x), rel=1e-12)


def test_booleans(spark):
    x = [("True",), ("0",), ("yes",), (None,), ("maybe",), ("",)]
    assert values(spark, N.as_bool(F.col("x")), x, "x string") == [True, False, True, False, False, False]
    assert values(spark, N.coerce_bool(F.col("x")), x, "x string") == [True, False, True, None, True, False]


@pytest.mark.parametrize(("text", "want"), [("[1, 2.5]", [1, 2.5]), ("[np.float64(1.2)]", [1.2]), ("[1, [2]]", None), ("[1, True]", None), ("[1,]", [1]), ("[]", None), ("text [1,2] more [3]", [3]), ("none", None), (None, None), ("[1_000, .5, 1., +1e2]", [1000, 0.5, 1, 100])])
def test_last_list(spark, text, want):
    assert values(spark, T.last_list(F.col("x")), [(text,)], "x string") == [want]


def test_text_macros(spark):
    one = lambda e, x: values(spark, e(F.col("x")), [(x,)], "x string")[0]
    assert one(T.slugify, " A/b  C! ") == "a-b-c"
    assert one(T.normalize_text, "\n A_b\t c ") == "a b c"
    assert one(T.strip_fences, "code\n```\n ``` \n") == "code"
    assert one(T.scenario_name, "Scenario 3") == "S3"
    assert one(T.scenario_name, "other") == "OTHER"
    assert one(lambda c: T.tail(c, 2), "a\nb\nc") == "b\nc"
    assert one(lambda c: T.relative_path(c, "/old/root"), "/old/root\\x\\y") == "x/y"
    assert one(lambda c: T.field(c, "Trend"), "Trend:\nnext") == "next"
    assert one(lambda c: T.first_keyword(c, {"arima": "Statistical", "sarimax": "Multivariate"}), "sarimax") == "Multivariate"
    assert one(lambda c: T.first_keyword(c, {"arima": "Statistical", "sarimax": "Multivariate"}), "sarimax+x") == "Statistical"
    assert one(T.from_python_dict, "{'order': (1, 2), 'a': True}") == '{"order": [1, 2], "a": true}'
    assert one(T.canonical_json, '{"b": 1.123456, "a": "x", "c": 2}') == '{"a": "x", "b": 1.1235, "c": 2}'


def table_of(spark, ys):
    rows = [("s", i, float(y)) for i, y in enumerate(ys)]
    return series.assembled(spark.createDataFrame(rows, "series_id string, period int, y double"), "series_id")


def forecasts(spark, ys, **kw):
    return {(r["scenario"], r["model"], r["t"]): r["forecast"] for r in forecast.naive(table_of(spark, ys), "series_id", **kw).collect()}


def test_naive_protocols_by_simulation(spark):
    ys, m, b = list(np.random.RandomState(1).randint(0, 99, 43)), 7, 4
    got, n = forecasts(spark, ys, season=m, block=b), int(43 * 0.8)

    def seasonal(history, steps):
        out = list(history)
        for _ in range(steps):
            out.append(out[-m] if len(out) >= m else out[-1])
        return out[len(history):]

    for model, f in (("naive-flat", lambda h, k: [h[-1]] * k), ("naive-seasonal", seasonal)):
        static = f(ys[:n], 43 - n)
        for t in range(n, 43):
            assert got["S1", model, t] == static[t - n]
            assert got["S2", model, t] == got["S3", model, t] == f(ys[:t], 1)[0]
            s = n + (t - n) // b * b
            assert got["S4", model, t] == f(ys[:s], b)[t - s]


def test_forecast_properties(spark):
    ys = [float(x) for x in np.random.RandomState(2).randint(0, 99, 30)]
    a, b = forecasts(spark, ys, season=1, block=1), forecasts(spark, ys, season=5, block=99)
    assert all(a["S2", "naive-seasonal", t] == a["S2", "naive-flat", t] == a["S4", "naive-flat", t] for t in range(24, 30))
    assert all(b["S4", m, t] == b["S1", m, t] for m in forecast.MODELS for t in range(24, 30))
    with pytest.raises(ValueError):
        forecast.naive(table_of(spark, ys), "series_id", models=("other",))


def test_models_learn_a_trend(spark):
    for model in (forecast.arima, forecast.autoregressive):
        rows = model(table_of(spark, [3.0 * i for i in range(60)]), "series_id", season=1, scenarios=("S1", "S2", "S4")).collect()
        assert len(rows) == 36
        for r in rows:
            assert r["forecast"] == pytest.approx(r["actual"], rel=1e-6)


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 0.0, 0.0), ("a", float("nan"), 1.0), ("b", None, 1.0), ("c", 2.0, 2.0)], "k string, actual double, forecast double")
    got = {r["k"]: r for r in metrics.evaluate(df, "k").collect()}
    assert (got["a"]["n"], got["a"]["mae"], got["a"]["smape"]) == (2, 0.5, pytest.approx(100 * (2 / 3) / 2, abs=1e-6))
    assert got["b"]["n"] == 0 and got["b"]["mae"] is None
    assert got["c"]["r2"] is None


def test_naive_scale_skips_what_is_not_finite(spark):
    got = metrics.naive_scale(table_of(spark, [1, float("nan"), 3, 7, 9, 9, 9, 9, 0, 0]), "series_id", season=1).first()
    assert (got["n_lagged"], got["scale"]) == (6, pytest.approx(8 / 6))


def test_mase_of_the_naive_forecast_on_train_is_one(spark):
    ys = [float(x) for x in np.random.RandomState(3).randint(1, 99, 40)]
    scale = metrics.naive_scale(table_of(spark, ys), "series_id", season=4).first()["scale"]
    assert np.mean([abs(ys[t] - ys[t - 4]) for t in range(4, 32)]) == pytest.approx(scale)


def pairs(spark, d1, d2):
    return spark.createDataFrame([("k", t, float(a), float(b), float(a), float(c)) for t, (a, b, c) in enumerate(zip(range(len(d1)), d1, d2, strict=True))], "k string, t int, actual double, forecast double, ref_actual double, ref_forecast double")


def test_diebold_mariano(spark):
    r = np.random.RandomState(4)
    a, b = r.rand(40) * 9, r.rand(40) * 5
    ab = stats.diebold_mariano(stats.loss_differences(pairs(spark, a, b), "k"), "k", horizon=5).first()
    ba = stats.diebold_mariano(stats.loss_differences(pairs(spark, b, a), "k"), "k", horizon=5).first()
    y = np.arange(40.0)
    d = (y - a) ** 2 - (y - b) ** 2
    c = d - d.mean()
    v = (c @ c + 2 * sum((1 - k / 5) * (c[k:] @ c[:-k]) for k in range(1, 5))) / 40
    assert ab["dm_statistic"] == pytest.approx(d.mean() / math.sqrt(v / 40)) and ab["dm_statistic"] == pytest.approx(-ba["dm_statistic"])
    assert ab["dm_p"] == pytest.approx(math.erfc(abs(ab["dm_statistic"]) / math.sqrt(2)))
    same = stats.diebold_mariano(stats.loss_differences(pairs(spark, a, a), "k"), "k").first()
    assert same["dm_mean"] == 0 and same["dm_statistic"] is None and same["dm_p"] is None
    tiny = pairs(spark, a, b).select("k", "t", *[(F.col(c) * 1e-8).alias(c) for c in ("actual", "forecast", "ref_actual", "ref_forecast")])
    assert stats.diebold_mariano(stats.loss_differences(tiny, "k"), "k", horizon=5).first()["dm_statistic"] == pytest.approx(ab["dm_statistic"])
    other = pairs(spark, a, b).withColumn("ref_actual", F.col("ref_actual") + 1)
    assert stats.loss_differences(other, "k").count() == 0


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, None, 0.2, 0.04]
    # null p-values keep their rows and don't count
    got = {r["i"]: r["q"] for r in stats.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", "i").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    want, low = {}, 1.0
    for k in range(len(known), 0, -1):
        low = min(low, known[k - 1][0] * len(known) / k)
        want[known[k - 1][1]] = low
    assert got[3] is None and all(got[i] == pytest.approx(q) and got[i] >= ps[i] for i, q in want.items())


def test_wilcoxon(spark):
    df = spark.createDataFrame([("a", 0.0, float(x)) for x in (1, 2, 3, 4, -5, 0)] + [("z", 1.0, 1.0)], "k string, base double, challenger double")
    got = {r["k"]: r for r in stats.wilcoxon(df, "k").collect()}
    assert (got["a"]["n_pairs"], got["a"]["n_nonzero"], got["a"]["w"]) == (6, 5, 5.0)
    assert (got["z"]["w"], got["z"]["p"]) == (0.0, 1.0)
    exact = stats.wilcoxon_exact(df, "k").first()
    assert exact["p"] == pytest.approx(2 * 10 / 32)  # ten of the 32 sign patterns have a rank sum of 5 or less
    tiny = df.select("k", (F.col("base") * 1e-8).alias("base"), (F.col("challenger") * 1e-8).alias("challenger"))
    assert stats.wilcoxon_exact(tiny, "k").first()["p"] == exact["p"] and stats.wilcoxon(tiny, "k").where("k = 'a'").first()["w"] == 5.0
    large = spark.createDataFrame([("b", 0.0, float(i if i % 3 else -i)) for i in range(1, 80)], "k string, base double, challenger double")
    both = {r["k"]: r for r in stats.wilcoxon_exact(df.unionByName(large), "k").collect()}
    assert (both["a"]["method"], both["b"]["method"], both["b"]["n"]) == ("exact", "approximate", 79) and both["b"]["p"] == stats.wilcoxon(large, "k").first()["p"]
    assert stats.student_p(0.5, 10) == pytest.approx(0.14111328, abs=1e-7)


def test_vote(spark):
    rows = [("g", 1, "m", "a"), ("g", 2, "n", "a"), ("g", 3, "m", "b"), ("g", 4, "n", "b")]
    top = ledger.top_vote(spark.createDataFrame(rows, "k string, i int, model string, p string"), "model", "i", "k").first()
    assert (top["model"], top["votes"], top["total"]) == ("m", 2, 4)
    rows = [("g", i, "m", p, c) for i, (p, c) in enumerate([("a1", "a"), ("a2", "a"), ("b1", "b"), ("a2", "a"), ("b1", "b")])]
    vote = ledger.two_level_vote(spark.createDataFrame(rows, "k string, i int, model string, parameters string, core string"), "i", "k").first()
    assert (vote["level"], vote["parameters"], vote["parameter_votes"]) == ("core", "a2", 3)


def test_compliance_fixtures(spark):
    rows = [("S2", True, True, None, True, True, False, True, True, False), ("S2", True, True, None, True, True, False, True, False, False)]
    names = ["scenario", *[f"{p}_{r}" for p in ("expected", "t2", "t3") for r in protocol.SUPPORTED]]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'scenario' else 'boolean'}" for n in names)).coalesce(1)
    got = protocol.compliance(df, "scenario").collect()
    assert [(r["semantic"], r["implementation"], r["full_semantic"], r["full_implementation"]) for r in got] == [(100.0, 100.0, True, True), (100.0, 50.0, True, False)]


def test_failure_rules(spark):
    one = lambda e, x: values(spark, e(F.col("x")), [(x,)], "x string")[0]
    assert one(taxonomy.group, "SCRIPT_X") == "code issue" and one(taxonomy.group, "MISSING_PACKAGE") == "runtime/infra issue"
    status = {"HTTP 429: rate limit": "RATE_LIMIT", "quota is used up": "RATE_LIMIT", "Deadline exceeded": "TIMEOUT", "read timeout 503": "TIMEOUT", "HTTP 502": "API_ERROR", "Overloaded": "API_ERROR", "api said no": "REQUEST_FAILED"}
    assert {m: one(taxonomy.system_status, m) for m in status} == {m: f"SYSTEM_{v}" for m, v in status.items()}
    assert one(taxonomy.log_category, "STDOUT\n[1.0]\n") == "FORECAST_PARSE_FAILURE"
    assert one(taxonomy.log_category, "STDOUT\n\nSTDERR\nUserWarning: torch") == "SCRIPT_TORCH_WARNING"
    assert one(taxonomy.runtime_category, "RuntimeError: no") == "SCRIPT_RUNTIME_ERROR" and one(taxonomy.runtime_category, "KeyError runtimeerror tensor") == "SCRIPT_KEY_ERROR"
    script = "'''python\nimport a\nx = 'b'\n'''\n"
    assert one(transcripts.code_of, script) == "import a\nx = 'b'" and one(transcripts.code_of, "Text '''\nimport a\n'''") == "import a\n'''"
    assert one(transcripts.output_type, " error ") == "ERROR"
    assert one(lambda c: transcripts.csv_path_fixed(c, "in.csv"), "pd.read_csv('a.csv', sep=';')") == "pd.read_csv(r'in.csv', sep=';')"


def test_json_text(spark):
    one = lambda e, x: values(spark, e(F.col("x")), [(x,)], "x string")[0]
    assert one(T.canonical_json, '{"b": {"z": 1.23456, "a": [1, 2.0, {"y": true, "x": null}]}, "a": "t"}') == '{"a": "t", "b": {"a": [1, 2.0, {"x": null, "y": true}], "z": 1.2346}}'
    assert one(T.canonical_json, " ") == "{}" and one(T.canonical_json, "no") == "no"
    m = spark.createDataFrame([({"b": 1, "a": 2}, {"b": 9, "c": 3})], "x map<string,int>, y map<string,int>")
    r = m.select(T.sorted_json(F.col("x")).alias("s"), T.merged_maps(F.col("x"), F.col("y")).alias("m")).first()
    assert r["s"] == '{"a":2,"b":1}' and r["m"] == {"a": 2, "b": 9, "c": 3}


def test_list_problems(spark):
    one = lambda e, x: values(spark, e(F.col("x")), [(x,)], "x string")[0]
    assert one(T.list_problem, "a [1, [2, 3]] b") == "forecast list is not flat" and one(T.list_problem, "[1, 2] or [x]") == "no Python forecast list found"
    assert one(T.list_problem, "x [1] [2, np.float64(3.5)] y") is None and one(T.last_list, "x [1] [2, np.float64(3.5)] y") == [2.0, 3.5]
    assert one(T.list_problem, "['a']") == "forecast list has an item that is no number" and one(T.list_problem, "[]") is None


def test_lookups_and_reports(spark, tmp_path):
    known = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, at int, v string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {tuple(r) for r in ledger.last_lookup(rows, known, "at", "k").collect()} == {("a", "y"), ("b", None), ("c", None)}
    wide = spark.createDataFrame([("r", 1, 5, None), ("s", 2, 1, 3)], "k string, a int, b int, c int")
    assert summary.columns_by_total(wide, "k").columns == ["k", "b", "a", "c"]
    assert [r["line"] for r in tables.markdown(wide, "k", "k", "a").orderBy("n").collect()] == ["| k | a |", "| --- | --- |", "| r | 1 |", "| s | 2 |"]
    data = spark.createDataFrame([(str(i), i) for i in range(10)], "y string, d int")
    assert tables.series_of(data, "s", "y", "d").count() == 10
    for bad in (lambda: tables.series_of(data, "s", "z", "d"), lambda: tables.series_of(data.limit(0), "s", "y", "d"), lambda: tables.series_of(data.limit(1), "s", "y", "d")):
        with pytest.raises(ValueError):
            bad()
    tables.write_csv(wide, str(tmp_path / "c"))
    assert tables.csv(spark, str(tmp_path / "c"), "k string, a int, b int, c int").count() == 2
    f = spark.createDataFrame([("s", "S1", 1, 2.0)], "series_id string, scenario string, t int, forecast double")
    tables.write_forecasts(f, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).where("scenario = 'S1'").count() == 1
    old = spark.createDataFrame([("a", 9.0)], "k string, v double")
    new = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double")
    assert {tuple(r) for r in tables.reused(new, old, "k", "v").collect()} == {("a", 9.0), ("b", 2.0)}
    assert tables.with_schema_of(new, old.withColumn("v", F.col("v").cast("float"))).dtypes == [("k", "string"), ("v", "float")]


def test_scenarios_of_a_prompt(spark):
    from foretally.plans.protocols import PROMPT

    got = {r["scenario"]: r for r in protocol.scenario_requirements(spark.createDataFrame([(PROMPT,)], "text string")).collect()}
    assert got["S1"]["expected_retraining"] is False and got["S1"]["expected_ground_truth"] is False and got["S4"]["expected_blockwise"] and got["S5"]["expected_retraining"] is None
    assert got["S3"]["expected_multistep"] and got["S2"]["expected_multistep"] is None


def test_records(spark):
    one = lambda e, x: values(spark, e(F.col("x")), [(x,)], "x string")[0]
    turns = lambda c: records.chat_turns(c, records.chat_header(c))
    assert one(turns, "you asked\na\nClaude response\none\n\ntwo\nyou asked\nb\nclaude RESPONSE\nthree") == ["one\n\ntwo", "three"]
    assert one(turns, "no header") == [] and one(turns, None) == []
    assert one(records.first_response, "x\ngrok response\nyes\nyou asked\nno") == "yes" and one(records.first_response, "plain") == "plain"
    assert one(records.model_category, "Holt-Winters") == "Statistical" and one(records.model_category, "sarimax + x") == "Statistical" and one(records.model_category, "") == ""
    assert one(lambda c: records.file_parts(c)[5], "Part2-A-S1-Base-L-Run3") == "3" and one(lambda c: records.file_parts(c)[3], "Part2-A") == "NA"
    assert one(records.extra_text, "import x") is False


def test_summaries_skip_nan(spark):
    got = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double").agg(*summary.metric_stats(F.col("x"), "x")).first()
    assert (got["x_count"], got["x_mean"], got["x_std"]) == (1, 1.0, 0.0)
    none = spark.createDataFrame([(None,)], "x double").agg(*summary.metric_stats(F.col("x"), "x")).first()
    assert none["x_count"] == 0 and none["x_std"] is None


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name,v\nx,1.5\ny,\n", encoding="utf-8")
    got = tables.csv(spark, str(tmp_path / "a.csv"), "name string, v double").orderBy("name").collect()
    assert [tuple(r) for r in got] == [("x", 1.5), ("y", None)]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "one.txt").write_bytes(b"a\nb\xff")
    assert [r["file_name"] for r in tables.texts(spark, str(tmp_path / "t")).collect()] == ["one.txt"]
    setups = spark.createDataFrame([("A", 1)], "k string, m int")
    assert tables.lookup(spark.createDataFrame([("a",)], "k string"), setups, "k").first()["m"] == 1
    with pytest.raises(Exception, match="no setup"):
        tables.lookup(spark.createDataFrame([("b",)], "k string"), setups, "k").collect()
    df = spark.createDataFrame([(1,)], "x int")
    tables.append(df, str(tmp_path / "ap"), ["x", "y"])
    assert spark.read.parquet(str(tmp_path / "ap")).columns == ["x", "y"]


def test_stream_equals_batch(spark, tmp_path):
    from foretally.streaming import ledger as stream

    events = tables.table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(map(tuple, stream.window_counts(events).collect()))
    assert sorted(map(tuple, spark.table("counts").collect())) == want and want


def test_stream_ledger(spark, tmp_path):
    from foretally.streaming import ledger as stream

    runs = spark.createDataFrame([("a", 1), ("b", 2)], "run_key string, n int")
    runs.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(runs.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        stream.append_to(src, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_turns_of_a_log(spark):
    m = lambda n, who="ASSISTANT", more="": f"===== TURN {n} {who}{more} =====\n"
    one = lambda x: values(spark, transcripts.turns(F.col("x")), [(x,)], "x string")[0]
    assert one("head\n" + m(0) + "a\n" + m(0, "USER") + "q\n" + m(2) + "b" + "\n" + m(1) + "c\n" + m(2, more=" (again)") + "\n\nd\ne") == {0: "a\n", 1: "c\n", 2: "d\ne"}
    assert one(m(3) + "x ===== TURN 4 ASSISTANT ===== y\n" + m(3).lower() + "last\n===== TURN 5 ASSISTANT =====") == {3: "last\n"}
    assert one(m(99999999999) + "x\n") == {} and one("") == {} and one("no mark") == {} and one(None) is None
    from foretally.operators import master

    log = lambda *parts: "".join(parts)
    rows = [("a", log(m(0), "zero\n", m(3), "first\n", m(3), "import last\n")), ("b", log(m(0), "zero\n", m(5), "fifth\n")), ("c", "chatgpt said:\nhi\nyou asked\nq\nchatgpt said:\none\n"), ("d", "nothing"), ("e", None)]
    df = spark.createDataFrame(rows, "file_id string, log string")
    cut = df.select("file_id", "log", transcripts.turn_list(F.col("log")).alias("marked"))
    got = {r["file_id"]: r["a"] and (list(r["a"]["texts"]), r["a"]["n"]) for r in cut.select("file_id", master.answers(F.col("marked"), F.col("log")).alias("a")).collect()}
    assert got == {"a": (["zero", "", "", "import last"], 2), "b": (["zero", "", "", "fifth"], 2), "c": (["one", "", "", "one"], 2), "d": None, "e": None}
