"""Landed files that break off, and listings with gaps."""

import gzip
import json

import numpy as np
import pytest

from studyweave.operators import charts
from studyweave.plans import landing
from studyweave.sources import landed


def _write(folder, study, name, lines, packed=False):
    path = folder / f"study={study}" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    data = "".join(json.dumps(x) + "\n" for x in lines).encode()
    path.write_bytes(gzip.compress(data, mtime=0) if packed else data)
    return path


def _records(study, n):
    return [{"patientId": f"{study}{k}", "attrId": "AGE", "value": str(k)} for k in range(n)]


def test_a_broken_file_takes_its_study_out_and_no_other(spark, tmp_path):
    for study in ("a", "b", "c d+e%"):
        for part in range(2):
            _write(tmp_path, study, f"part-{part}.json.gz", _records(study, 3000), packed=True)
    broken = _write(tmp_path, "b", "part-2.json.gz", _records("b", 3000), packed=True)
    broken.write_bytes(broken.read_bytes()[:-900])
    _write(tmp_path, "p", "part-0.json", _records("p", 10))
    _write(tmp_path, "n", "part-0.json", []).write_text("\n \n")
    _write(tmp_path, "z", "part-0.json.gz", [], packed=True)
    (tmp_path / "study=c d+e%").rename(tmp_path / "study=c d+e%25")  # as Spark writes it
    states = {r.study: (r.n_files, r.n_failed, r.state) for r in landed.study_states(spark, str(tmp_path)).collect()}
    assert states == {
        "a": (2, 0, "read"), "b": (3, 1, "failed"), "c d+e%": (2, 0, "read"), "p": (1, 0, "read"),
        "n": (1, 0, "empty"), "z": (1, 0, "empty"),
    }
    records, bad = landed.read_clinical(spark, str(tmp_path))
    assert {r.study_id: r["count"] for r in records.groupBy("study_id").count().collect()} == {"a": 6000, "c d+e%": 6000, "p": 10}
    assert bad.count() == 0
    roster, _ = landed.read_roster(spark, str(tmp_path))
    assert {r.study_id: r["count"] for r in roster.groupBy("study_id").count().collect()} == {"a": 3000, "c d+e%": 3000, "p": 10}


@pytest.mark.parametrize("end", [b'"}\n', b'"}', b'"}{', b'x', b"\n\n", b" "])
def test_a_large_compressed_file_is_judged_without_being_held(spark, tmp_path, monkeypatch, end):
    """Wherever it breaks off, and whatever a whole one ends in."""
    monkeypatch.setattr(landed, "WHOLE_BYTES", 0)
    rng, lines = np.random.default_rng(5), []
    for k in range(1500):
        lines.append(json.dumps({"patientId": f"a{k}", "attrId": "AGE", "value": str(rng.integers(1 << 62))}))
    data = gzip.compress("\n".join(lines).encode() + end, mtime=0)
    _write(tmp_path, "whole", "part-0.json.gz", []).write_bytes(data)
    for k, at in enumerate((1, 12, 40, 200, 5000, 5001, 5002, 5003, len(data) // 2, len(data) - 9, len(data) - 1)):
        _write(tmp_path, f"cut{k}", "part-0.json.gz", []).write_bytes(data[:at])
    _write(tmp_path, "blank", "part-0.json.gz", []).write_bytes(gzip.compress(b" \n" * 50, mtime=0))
    states = {r.study: r.state for r in landed.study_states(spark, str(tmp_path)).collect()}
    assert states.pop("whole") == "read" and states.pop("blank") == "empty"
    assert set(states.values()) == {"failed"} and len(states) == 11


def test_no_row_holds_a_large_compressed_file(spark, tmp_path):
    """Of the rows that hold a file, only those of small files are read."""
    rows = spark.range(400_000).selectExpr("""concat('{"patientId": "', md5(string(id)), '"}') AS value""").coalesce(1)
    rows.write.option("compression", "gzip").text(str(tmp_path / "study=a"))
    _write(tmp_path, "b", "part-0.json.gz", _records("b", 10), packed=True)
    whole, cut = (landed._packed(spark, str(tmp_path), taken, wholetext=taken) for taken in (True, False))
    assert (whole.rdd.getNumPartitions(), whole.count()) == (1, 1)  # the large one is not opened
    assert cut.count() == 400_000
    assert {r.study: r.state for r in landed.study_states(spark, str(tmp_path)).collect()} == {"a": "read", "b": "read"}


def test_a_plain_file_that_cannot_be_read_to_its_end(spark, tmp_path):
    spark.range(200_000).selectExpr("""concat('{"patientId": "p', id, '"}') AS value""").coalesce(1).write.text(str(tmp_path / "study=a"))
    _write(tmp_path, "b", "part-0.json", [{"patientId": "x"}])
    part = next((tmp_path / "study=a").glob("part-*"))
    data = bytearray(part.read_bytes())
    data[len(data) // 2] ^= 1  # no longer what its checksum says
    part.write_bytes(bytes(data))
    states = {r.study: r.state for r in landed.study_states(spark, str(tmp_path)).collect()}
    assert states == {"a": "failed", "b": "read"}
    roster, _ = landed.read_roster(spark, str(tmp_path))
    assert [tuple(r) for r in roster.collect()] == [("b", "x")]


def test_lines_without_an_end_and_with_a_mark_are_whole(spark, tmp_path):
    _write(tmp_path, "a", "part-0.json", []).write_bytes(b'\xef\xbb\xbf{"patientId": "x"}\r\n{"patientId": "y"}')
    assert [r.state for r in landed.file_states(spark, str(tmp_path)).collect()] == ["read"]
    roster, bad = landed.read_roster(spark, str(tmp_path))
    assert sorted(r.patient_id for r in roster.collect()) == ["x", "y"] and bad.count() == 0


def _pages(folder, sizes, one_array=False):
    folder.mkdir()
    for number, n in sizes.items():
        entries = [{"studyId": f"s{number}_{k}", "name": "x"} for k in range(n)]
        text = json.dumps(entries, indent=1) if one_array else "".join(json.dumps(e) + "\n" for e in entries) or "[]"
        (folder / f"page-{number}.json").write_text(text)
    return str(folder)


@pytest.mark.parametrize("one_array", [False, True])
def test_gaps_of_a_listing(spark, tmp_path, one_array):
    folder = _pages(tmp_path / "a", {0: 5, 1: 4, 3: 6, 10: 5, 11: 2}, one_array)
    found = {r.page: (r.n_rows, r.state) for r in landed.listing_pages(spark, folder, 5, multi_line=one_array).collect()}
    assert found == {0: (5, "whole"), 1: (4, "short"), 3: (6, "over"), 10: (5, "whole"), 11: (2, "last")} | {
        k: (0, "missing") for k in (2, 4, 5, 6, 7, 8, 9)
    }
    open_end = landed.listing_pages(spark, _pages(tmp_path / "b", {0: 5, 1: 5}, one_array), 5, multi_line=one_array)
    assert [(r.page, r.state) for r in open_end.orderBy("page").collect()] == [(0, "whole"), (1, "open")]
    closed = landed.listing_pages(spark, _pages(tmp_path / "c", {0: 5, 1: 0}, one_array), 5, multi_line=one_array)
    assert [(r.page, r.n_rows, r.state) for r in closed.orderBy("page").collect()] == [(0, 5, "whole"), (1, 0, "last")]


def test_entries_that_cannot_be_read_and_files_without_a_number(spark, tmp_path):
    folder = _pages(tmp_path / "a", {0: 2})
    (tmp_path / "a/page-1.json").write_text('{"studyId": "x"}\n[{"studyId": "y\n')
    (tmp_path / "a/notes.json").write_text('{"studyId": "z"}\n')
    found = {r.page: (r.n_rows, r.state) for r in landed.listing_pages(spark, folder, 3).collect()}
    assert found == {0: (2, "short"), 1: (2, "last"), None: (1, "unnumbered")}


def test_cut_short_halves_the_last_file(spark, tmp_path):
    (tmp_path / "a").write_text("0123456789")
    (tmp_path / "b").write_text("0123456789")
    landing.cut_short(spark, str(tmp_path))
    assert ((tmp_path / "a").read_text(), (tmp_path / "b").read_text()) == ("0123456789", "01234")


def test_density_is_a_kernel_over_bins(spark):
    rng = np.random.default_rng(1)
    values = {"a": rng.normal(50, 12, 400).round(1), "b": rng.exponential(3, 57), "one": np.array([4.0]), "same": np.full(9, 2.5), "two": np.array([0.0, 1.0])}
    rows = [(g, float(x)) for g, xs in values.items() for x in xs] + [("a", None), ("none", None)]
    found: dict = {}
    for r in charts.density(spark.createDataFrame(rows, "g string, x double"), ["g"], "x", lambda counts: counts, 32).collect():
        found.setdefault(r.g, {})[r.bin] = (r.n, r.width, r.x, r.density)
    assert set(found) == {"a", "b", "same", "two"}
    for g in ("a", "b", "two"):
        x = values[g]
        iqr = np.subtract(*np.percentile(x, [75, 25])) / 1.34
        width = 0.9 * min(x.std(ddof=1), iqr) * len(x) ** -0.2
        places = np.linspace(x.min(), x.max(), 32)
        at = (x - x.min()) / (places[1] - places[0])
        low = np.minimum(np.floor(at), 31).astype(int)
        weights = np.bincount(low, 1 - (at - low), 33) + np.bincount(low + 1, at - low, 33)
        want = [(weights[:32] * np.exp(-0.5 * ((p - places) / width) ** 2)).sum() / (len(x) * width * np.sqrt(2 * np.pi)) for p in places]
        got = [found[g][k] for k in range(32)]
        assert np.allclose([w for _, w, _, _ in got], width) and np.allclose([p for _, _, p, _ in got], places)
        assert np.allclose([d for *_, d in got], want, rtol=1e-6)
    exact = [np.exp(-0.5 * ((p - values["a"]) / found["a"][0][1]) ** 2).mean() / (found["a"][0][1] * np.sqrt(2 * np.pi)) for _, _, p, _ in (found["a"][k] for k in range(32))]
    assert np.allclose([found["a"][k][3] for k in range(32)], exact, atol=0.002)
    assert list(found["same"]) == [0] and found["same"][0][2] == 2.5
