from lexspan.__main__ import arguments, main, run


def test_steps(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for clip in ("a", "b"):
        (tmp_path / "w" / f"{clip}.json").write_text('[{"word": "Damn,", "start": 1.0, "end": 1.4}, {"word": "fine", "start": 2.0, "end": 2.5}]')
    w, out = f"{tmp_path}/w", f"{tmp_path}/out"
    assert run(spark, arguments(["match", w, out])).count() == 2
    assert run(spark, arguments(["match", w, f"{out}1", "--limit", "1"])).count() == 1
    assert run(spark, arguments(["match", w, f"{out}1", "--skip-existing"])).count() == 2
    rows = run(spark, arguments(["plan", w, f"{out}2", "--lead-in-ms", "30", "--total-ms", "5000"])).where("clip = 'a'").orderBy("seq").collect()
    assert [(r["kind"], r["src_start_ms"], r["src_end_ms"]) for r in rows] == [("gap", 0, 970), ("silence", 970, 1000), ("replacement", 1000, 1400), ("final", 1400, 5000)]
    files = tmp_path / "f" / "a"
    files.mkdir(parents=True)
    (files / "00001000_00001400_dang.wav").write_bytes(b"1")
    rows = run(spark, arguments(["plan", w, f"{out}3", "--files", f"{tmp_path}/f"])).collect()
    assert {(r["clip"], r["kind"]) for r in rows} == {("a", "gap"), ("a", "replacement"), ("a", "final"), ("b", "final")}
    shares = {r["clip"]: round(r["share"], 6) for r in run(spark, arguments(["simulate", w])).collect()}
    assert shares == {"a": 16.0, "b": 16.0}
    (tmp_path / "m.json").write_text('{"clip": "a", "status": "clean"}\n{"clip": "b", "status": "clean"}\n')
    assert {r["status"]: r["n"] for r in run(spark, arguments(["status", f"{tmp_path}/m.json"])).collect()} == {"censored": 0, "clean": 2, "skipped": 0, "error": 0}
    assert main(["simulate", f"{tmp_path}/none"]) == 2
    (tmp_path / "bad.json").write_text("{}")
    assert main(["simulate", f"{tmp_path}/bad.json"]) == 1


def test_batch(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for clip, body in (("a", '[{"word": "Damn,", "start": 1.0, "end": 1.4}]'), ("b", '{"word": "x"}'), ("c", '[{"word": "fine", "start": 2.0, "end": 2.5}]'), ("d", "[]")):
        (tmp_path / "w" / f"{clip}.json").write_text(body)
    w, out = f"{tmp_path}/w", f"{tmp_path}/out"
    status = lambda *more: {r["clip"]: r["status"] for r in run(spark, arguments(["batch", w, *more])).collect()}
    assert status(out) == {"a": "censored", "b": "error"}
    assert status(f"{out}1", "--continue-on-error", "--copy-clean") == {"a": "censored", "b": "error", "c": "clean", "d": "clean"}
    assert {r["clip"] for r in spark.read.json(f"{out}1-copied").collect()} == {"c", "d"}
    assert status(f"{out}1", "--continue-on-error", "--skip-existing") == {"a": "skipped", "b": "error", "c": "skipped", "d": "skipped"}
    assert [r["state"] for r in run(spark, arguments(["batch", w, f"{out}2", "--dry-run"])).collect()] == ["OK"]
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "none.wav").write_bytes(b"1")
    assert [r["state"] for r in run(spark, arguments(["batch", w, f"{out}2", "--dry-run", "--files", f"{tmp_path}/f"])).collect()] == ["MISSING"]
    assert not (tmp_path / "out2").exists()
    logged = ("--log", f"{tmp_path}/log", "--slices", "2")
    assert status(f"{out}3", *logged) == {"a": "censored", "b": "error", "c": "clean", "d": "clean"}
    (tmp_path / "w" / "e.json").write_text("[]")
    assert status(f"{out}4", *logged) == {"a": "censored", "b": "error", "c": "clean", "d": "clean", "e": "clean"}
    assert len(list((tmp_path / "log").glob("slice-*"))) == 4
