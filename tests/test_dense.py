"""Dense text against a plain parser."""

from __future__ import annotations

import random

import pytest

from sketchframe.sources import dense


def plain(lines):
    return {(r, c): float(t) for r, line in enumerate(lines) if line for c, t in enumerate(line.split(",")) if float(t) != 0}


def test_all_number_forms(spark, tmp_path, monkeypatch):
    """Cells that fall across a border between pieces included."""
    monkeypatch.setattr(dense, "PIECE", 5)
    rng = random.Random(0)
    forms = ["0", "1", "0", "0.0", "-0.5", "12.25", "0e9", "1.500e+01", "-3", "00", "7e-300", " 0", " 4", "inf"]
    lines = ["", "0", "1", "0,0,0", "1,1", *(",".join(rng.choice(forms) for _ in range(rng.randrange(1, 40))) for _ in range(60)), ""]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    got = {(r["row_id"], r["col"]): r["v"] for r in dense.read_dense_csv(spark, str(tmp_path)).collect()}
    assert got == plain(lines)


def test_what_is_no_number_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("0,x1,0\n")
    with pytest.raises(Exception, match="could not convert"):
        dense.read_dense_csv(spark, str(tmp_path)).collect()


def test_a_line_of_ten_million_columns(spark, tmp_path):
    """Pieces of fixed size leave the JVM, so what Python holds does not follow the width."""
    ones, width = {0, 4095, 4096, 5_000_000, 9_999_999}, 10_000_000
    line = bytearray(b"0," * width)
    for c in ones:
        line[2 * c] = ord("1")
    (tmp_path / "a.csv").write_bytes(bytes(line[:-1]) + b"\n0,1\n")
    got = sorted((r["row_id"], r["col"], r["v"]) for r in dense.read_dense_csv(spark, str(tmp_path)).collect())
    assert got == sorted([(0, c, 1.0) for c in ones] + [(1, 1, 1.0)])


def test_scanner_holds_no_more_than_a_cell():
    scanner, width = dense.Scanner(), 0
    for _ in range(1000):
        scanner.feed(b"0,0,0,0,0.00", False)
        width = max(width, len(scanner.rest))
    assert width == 4 and scanner.col == 4000
