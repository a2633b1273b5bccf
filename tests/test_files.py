"""Readers, writers and arriving records, on files written by the tests."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from wearline.operators import frames as fr
from wearline.operators import metrics
from wearline.sources import files
from wearline.streaming import arrivals


def test_trajectories_and_terminal_labels(spark, tmp_path):
    lines = ["1 1 0.5 0.1 100 7 NaN", " 1 2  0.6 0.1 100 8 NaN ", "2 1 0.4 0.2 100 9 NaN", ""]
    (tmp_path / "train_FD001.txt").write_text("\n".join(lines))
    cols = ["unit", "cycle", "setting1", "setting2", "setting3", "s1", "s2"]
    df = files.read_trajectories(spark, str(tmp_path / "train_*.txt"), cols)
    assert df.columns == ["dataset", *cols[:-1]]
    assert sorted((r.dataset, r.unit, r.cycle, r.s1) for r in df.collect()) == [
        ("FD001", 1, 1, 7.0),
        ("FD001", 1, 2, 8.0),
        ("FD001", 2, 1, 9.0),
    ]
    (tmp_path / "RUL_FD001.txt").write_text("112\n98\n")
    labels = files.read_terminal_labels(spark, str(tmp_path / "RUL_*.txt"))
    last = fr.last_observation(df, ["s1"])
    got = {r.unit: r.rul for r in fr.attach_terminal_labels(last, labels).collect()}
    assert got == {1: 112.0, 2: 98.0}


def test_label_lines_keep_their_number_across_file_blocks(spark, tmp_path):
    (tmp_path / "RUL_FD002.txt").write_text("".join(f"{i % 97}\n" for i in range(20000)))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        got = files.read_terminal_labels(spark, str(tmp_path / "RUL_FD002.txt")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    assert sorted((r.pos, r.rul) for r in got) == [(i + 1, float(i % 97)) for i in range(20000)]


def write_trace(path, rows):
    path.write_text(json.dumps(rows))


def test_array_files_are_read_in_byte_ranges(spark, tmp_path):
    """Strings with braces, quotes and backslashes, nested objects, and every layout of a file, cut at any byte."""
    rng = random.Random(4)
    marks = ["{", "}", '"', "\\", "\n", ",", "[", "]", "é", "日", " word ", '\\"}', "}, {", "\\\\"]
    record = lambda i: {
        "engine_id": i, "true_rul": 1.5 * i, "pred_rul": None if i % 7 == 0 else i,
        "reasoning": "".join(rng.choices(marks, k=rng.randint(0, 30))), "raw": "x" * rng.choice([0, 0, 900]),
    }
    files_ = {"one": [record(i) for i in range(400)], "two": [record(1000 + i) for i in range(50)], "three": [], "four": [record(9)]}
    for k, (name, rows) in enumerate(files_.items()):
        nested = [{**r, "more": {"a": {"b": "}"}, "c": [{}, {"d": "{"}]}} if r["engine_id"] % 5 == 0 else r for r in rows]
        text = json.dumps(nested, indent=[None, 2, None, 1][k], ensure_ascii=k % 2 == 0)
        (tmp_path / f"traces_FD001_{name}_k3_n15_run{k}.json").write_text(text + "\n" * k)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("1500", "7001", keep):
        try:
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert size == keep or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 4
            got = files.read_traces(spark, str(tmp_path)).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
        want = sorted((r["engine_id"], r["true_rul"], r["pred_rul"], r["reasoning"], r["raw"]) for rows in files_.values() for r in rows)
        assert sorted((r.unit, r.truth, r.pred, r.text, r.raw) for r in got) == want


def test_traces_and_manifest(spark, tmp_path):
    rows = [{"engine_id": 1, "true_rul": 112.0, "pred_rul": 45, "reasoning": "s11 rising"}, {"engine_id": 2, "true_rul": 98.0, "pred_rul": None}]
    write_trace(tmp_path / "traces_FD001_few_shot_k3_n15_run2.json", rows)
    write_trace(tmp_path / "traces_p0_FD001_zs_n30_nocue.json", [{**rows[0], "arm": "nocue"}])
    got = {(r.file, r.unit): r for r in files.read_traces(spark, str(tmp_path / "traces_*.json")).collect()}
    r = got["traces_FD001_few_shot_k3_n15_run2.json", 1]
    assert (r.dataset, r["mode"], r.k, r.n_cycles, r.run, r.pred, r.text) == ("FD001", "few_shot", 3, 15, "run2", 45.0, "s11 rising")
    assert got["traces_FD001_few_shot_k3_n15_run2.json", 2].pred is None
    assert got["traces_p0_FD001_zs_n30_nocue.json", 1].variant == "nocue"
    man = {r.path.split("/")[-1]: r for r in files.file_manifest(spark, str(tmp_path / "traces_*.json")).collect()}
    for name, row in man.items():
        data = (tmp_path / name).read_bytes()
        assert (row.bytes, row.sha256) == (len(data), hashlib.sha256(data).hexdigest())
    full = {r.file: r for r in files.trace_manifest(spark, str(tmp_path / "traces_*.json")).collect()}
    r = full["traces_FD001_few_shot_k3_n15_run2.json"]
    assert (r.n, r.rmse, r.modal_value, r.run, r.seed) == (1, 67.0, 45.0, "run2", None)


def test_experiment_classes(spark, tmp_path):
    names = {
        "results/traces_FD001_zero_shot_k0.json": "original grid",
        "results_p0/traces_p0_FD001_zs_n30_repl.json": "control arms",
        "results_p1/traces_p1_FD001_fs_k5_n5_strat_seed1.json": "example-set experiment",
        "results_p1/traces_p1_grid_FD001_fs_k3_n15.json": "corrected grid",
        "results_p1/traces_p2_FD002_zs_n30.json": "multi-condition",
        "results_p1/traces_p1_FD001_zs_n30_mistral_7b.json": "model sweep",
    }
    for name in names:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("[]")
    same = tmp_path / "results_p0" / "traces_FD001_zero_shot_k0.json"
    same.write_text('[{"engine_id": 1, "true_rul": 1.0, "pred_rul": 2.0}]')
    names["results_p0/traces_FD001_zero_shot_k0.json"] = "control arms"
    classes = (
        ("original grid", r"/results/[^/]+$"),
        ("control arms", r"/results_p0/[^/]+$"),
        ("corrected grid", r"_grid_[^/]*$"),
        ("example-set experiment", r"_(asis|strat|random)_seed[^/]*$"),
        ("multi-condition", r"/traces_p2_[^/]*$"),
    )
    where = str(tmp_path / "results*" / "*.json")
    root = f"file:{tmp_path}/"
    got = {r.below_root: r.experiment for r in files.file_manifest(spark, where, classes, "model sweep", root).collect()}
    assert got == names
    runs = {r.path.removeprefix(root): r for r in files.trace_manifest(spark, where, classes, default_model="base").collect()}
    assert len(runs) == len(names)
    assert runs["results_p0/traces_FD001_zero_shot_k0.json"].n == 1
    assert runs["results/traces_FD001_zero_shot_k0.json"].n is None


@pytest.mark.parametrize("wrap, root", [(w, r) for w in (False, True) for r in ("readings", "letture", None)])
def test_labels_in_either_layout(spark, tmp_path, wrap, root):
    record = {"case": 3, "sensor": "s2", "first_label": " Increase ", "label": "stable", "first_at": "2026-09-07T10:00:00"}
    record = {"data": record} if wrap else record
    body = {"note": "n", root: [record]} if root else [record]
    (tmp_path / "export.json").write_text(json.dumps(body, indent=1))
    got = files.read_labels(spark, str(tmp_path / "export.json")).collect()
    assert [(r.case, r.sensor, r.label, r.revealed) for r in got] == [(3, "s2", "increase", False)]


def test_summaries_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "config string, rho double")
    files.write_summary(df, str(tmp_path / "out"))
    back = files.read_summary(spark, str(tmp_path / "out"), "config string, rho double")
    assert sorted(back.collect()) == sorted(df.collect())
    (tmp_path / "nan.csv").write_text("config,rho\na,NaN\n")
    assert files.read_summary(spark, str(tmp_path / "nan.csv"), "config string, rho double").first().rho is None


def test_claims_are_written_by_dataset(spark, tmp_path):
    df = spark.createDataFrame([("D0", 1), ("D1", 2)], "dataset string, unit int")
    files.write_claims(df, str(tmp_path / "claims"))
    plan = spark.read.parquet(str(tmp_path / "claims")).where("dataset = 'D1'")
    assert [r.unit for r in plan.collect()] == [2]
    assert (tmp_path / "claims" / "dataset=D1").is_dir()


def test_arriving_records_skip_finished_keys(spark, tmp_path):
    folder, store, mark = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "mark")
    folder.mkdir()
    schema = "config string, unit bigint, pred double, truth double"

    def arrive(name, *rows):
        (folder / name).write_text("\n".join(json.dumps(dict(zip(("config", "unit", "pred", "truth"), r))) for r in rows))
        stream = arrivals.arriving_records(spark, str(folder), schema)
        arrivals.append_new(stream, store, mark, ["config", "unit"]).awaitTermination(120)

    arrive("1.json", ("a", 1, 10.0, 12.0), ("a", 1, 10.0, 12.0), ("a", 2, 10.0, 10.0))
    arrive("2.json", ("a", 2, 99.0, 10.0), ("a", 3, 14.0, 10.0))
    mark = str(tmp_path / "another")  # a new checkpoint sees every file again and must keep what is stored
    arrive("3.json", ("a", 3, 77.0, 10.0))
    got = arrivals.stored_metrics(spark, store, ["config"]).first()
    assert got.n == 3 and got.rmse == pytest.approx(((4 + 0 + 16) / 3) ** 0.5)


def test_running_metrics_of_late_and_repeated_records(spark, tmp_path):
    """In runs over arriving files, state alone gives the errors and concentration of the whole."""
    rng = random.Random(3)
    schema = "config string, unit bigint, pred double, truth double, at timestamp"
    rows = [(f"c{i % 3}", i, float(rng.randint(0, 5)), float(rng.randint(0, 40)), f"2024-01-{1 + i // 30:02d} 0{i % 9}:00:00") for i in range(180)]
    late = rows[5:9] + rows[100:104]  # they come a run later, within the delay
    runs = [[r for r in rows[:90] if r not in late], rows[60:150] + late[:4], rows[140:] + late[4:] + rows[175:], []]
    folder, store, out = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "out")
    folder.mkdir()
    seen = []
    for k, some in enumerate(runs):
        rng.shuffle(some)
        names = schema.replace(",", "").split()[::2]
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in some))
        stream = arrivals.arriving_records(spark, str(folder), schema)
        arrivals.append_distinct(stream, store, str(tmp_path / "mark"), ["config", "unit"], "at", "10 days").awaitTermination(120)
        running = arrivals.running_metrics(spark, store, schema, ["config"], out, str(tmp_path / "state"))
        for query in running:
            query.awaitTermination(120)
        seen.append(sum(p["numInputRows"] for p in running[0].recentProgress))
    assert sum(seen) == 180 and seen[1] < 100  # every stored record is read once
    whole = spark.createDataFrame([r[:4] for r in rows], "config string, unit bigint, pred double, truth double")
    for got, want in (
        (arrivals.current_errors(spark, out), metrics.error_metrics(whole, ["config"])),
        (arrivals.current_concentration(spark, out, ["config"]), metrics.concentration(whole, ["config"])),
    ):
        assert got.columns == want.columns
        for a, b in zip(got.orderBy("config").collect(), want.orderBy("config").collect(), strict=True):
            assert list(a)[1:] == pytest.approx(list(b)[1:])


def test_a_trace_file_of_many_parts_is_one_file(spark, tmp_path, monkeypatch):
    """No task writes or hashes a whole trace file, and the manifest has one row for it."""
    monkeypatch.setattr(files, "PART_ROWS", 10)
    name = "traces_FD0011_zero_shot_k0_n5.json"
    rows = spark.range(45).select(F.col("id").alias("engine_id"), F.lit(1.0).alias("true_rul"), F.lit(2.0).alias("pred_rul"), F.lit("r").alias("reasoning"), F.lit(name).alias("file"))
    files.write_traces(rows.repartition(2), str(tmp_path / "t"))
    parts = sorted(tmp_path.glob("t/*/part-*.json"))
    assert len(parts) >= 5 and max(len(p.read_text().splitlines()) for p in parts) <= 10
    found = files.trace_manifest(spark, str(tmp_path / "t"), array_files=False).collect()
    assert [(r.file, r.n, r.bytes) for r in found] == [(name, 45, sum(p.stat().st_size for p in parts))]
    hashes = "".join(hashlib.sha256(p.read_bytes()).hexdigest() for p in parts)
    assert found[0].sha256 == hashlib.sha256(hashes.encode()).hexdigest()
