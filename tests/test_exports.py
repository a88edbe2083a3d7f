"""Schematic files of both formats, and the data source that writes and reads them."""

import gzip
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from gatefold.sources import datasource, nbt, schematics, shared

GRID = bytes([1] * 256 + [k % 44 for k in range(1280)])


@given(st.integers(2, 9), st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_packed_numbers_straddle_words(bits, numbers, more):
    own = np.array(numbers, np.int64) + (more if bits > 3 else 0)
    whole = sum(int(x) << (k * bits) for k, x in enumerate(own))
    words = [whole >> (64 * k) & (1 << 64) - 1 for k in range(-(-len(own) * bits // 64))]
    got = schematics.packed(own, bits)
    assert [int(w) % (1 << 64) for w in got] == words
    assert schematics.unpacked(got, bits, len(own)).tolist() == own.tolist()


@pytest.mark.parametrize("form", ["schem", "litematic"])
@pytest.mark.parametrize("grid", [GRID, bytes(1536), bytes([1] * 256) + bytes(1280), bytes(random.Random(3).choices(range(44), k=1536))])
def test_both_formats_round_trip(form, grid):
    _, write, read = schematics.FORMATS[form]
    blob = write(grid, "a name é")
    assert blob == write(grid, "a name é")
    assert read(blob) == (16, 6, 16, [schematics.STATES[t] for t in grid])
    for bad in (bytes(1535), bytes([44]) + bytes(1535), bytes([200]) + bytes(1535)):
        with pytest.raises(ValueError):
            write(bad)


def test_the_second_format_by_its_fields():
    root = nbt.decode(schematics.to_litematic(GRID, "r"))
    region = root["Regions"]["r"]
    assert root["Version"] == 6 and root["MinecraftDataVersion"] == 3465 and root["Metadata"]["TotalBlocks"] == sum(t > 0 for t in GRID[256:])
    assert len(region["BlockStatePalette"]) == 44 and region["BlockStatePalette"][0] == {"Name": schematics.STATES[0]}
    assert len(region["BlockStates"]) == 1536 * 6 // 64
    assert schematics.width(1) == schematics.width(4) == 2 and schematics.width(5) == 3 and schematics.width(44) == 6


def broken(root, name):
    return nbt.encode(root, name)


def test_broken_files_are_refused():
    for blob in (b"", b"no gzip", gzip.compress(b"\x01"), gzip.compress(gzip.decompress(schematics.to_schem(GRID))[:-700])):
        for _, _, read in schematics.FORMATS.values():
            with pytest.raises(ValueError):
                read(blob)
    ok = {"Version": (nbt.INT, 2), "Width": (nbt.SHORT, 1), "Height": (nbt.SHORT, 1), "Length": (nbt.SHORT, 2), "Palette": (nbt.COMPOUND, {"a": (nbt.INT, 0), "b": (nbt.INT, 300)}), "BlockData": (nbt.BYTES, b"\x00\xac\x02")}
    assert schematics.from_schem(broken(ok, "x"))[3] == ["a", "b"]
    for change in ({"Version": (nbt.INT, 3)}, {"Width": (nbt.SHORT, 65)}, {"Width": (nbt.SHORT, 2)}, {"Palette": (nbt.COMPOUND, {"a": (nbt.INT, 0), "b": (nbt.INT, 0)})}, {"BlockData": (nbt.BYTES, b"\x00\x01")}, {"BlockData": (nbt.BYTES, b"\x00\xac")}, {"BlockData": (nbt.BYTES, b"\x00\x80\x80\x80\x80\x80\x01")}):
        with pytest.raises(ValueError):
            schematics.from_schem(broken(ok | change, "x"))


def test_the_source_writes_and_reads_files(spark, tmp_path):
    datasource.register(spark)
    path = f"file://{tmp_path}/grids"
    names = ["plain", "with/slash", "é ü", "..", "d" * 200]
    df = spark.createDataFrame([(n, bytearray(GRID), 1) for n in names], "name string, tokens binary, more int").repartition(3)
    df.write.format("schematic").option("form", "litematic").mode("append").save(path)
    got = spark.read.format("schematic").option("form", "litematic").option("partitionBytes", 1).load(path)
    assert sorted(r.name for r in got.collect()) == sorted(names) and got.rdd.getNumPartitions() == len(names)
    assert {(r.width, r.height, r.length, tuple(r.states), r.error) for r in got.collect()} == {(16, 6, 16, tuple(schematics.STATES[t] for t in GRID), None)}
    assert spark.read.format("schematic").load(path).count() == 0  # none of the other format
    df.limit(1).write.format("schematic").option("form", "litematic").mode("overwrite").save(path)
    assert spark.read.format("schematic").option("form", "litematic").load(path).count() == 1
    df.limit(0).write.format("schematic").mode("append").save(path)
    assert not [x for x in os.listdir(tmp_path / "grids") if x.startswith("_staging")]


def test_a_failed_write_leaves_nothing(spark):
    datasource.register(spark)
    for rows in ([("a", bytearray(GRID)), ("b", None)], [(None, bytearray(GRID))], [("a", bytearray(GRID)), ("a", bytearray(GRID))], [("a", bytearray(b"short"))]):
        path = shared.new_path(spark)
        df = spark.createDataFrame(rows, "name string, tokens binary").coalesce(1)
        with pytest.raises(PySparkException):
            df.write.format("schematic").mode("append").save(path)
        folder = path.removeprefix("file://")
        assert not os.path.isdir(folder) or os.listdir(folder) == []
    with pytest.raises(PySparkException, match="a schematic has a name"):
        spark.range(1).write.format("schematic").mode("append").save(shared.new_path(spark))


def test_broken_files_fail_or_are_reported(spark, tmp_path):
    datasource.register(spark)
    (tmp_path / "bad.schem").write_bytes(b"nothing")
    (tmp_path / "good.schem").write_bytes(schematics.to_schem(GRID))
    read = spark.read.format("schematic")
    with pytest.raises(PySparkException, match="bad.schem"):
        read.load(str(tmp_path)).collect()
    rows = {r.name: r for r in read.option("mode", "permissive").load(str(tmp_path)).collect()}
    assert rows["bad"].states is None and rows["bad"].error and rows["good"].error is None and len(rows["good"].states) == 1536


def test_schematics_of_a_column(spark):
    df = spark.createDataFrame([(1, bytearray(GRID)), (2, None)], "schematic0 int, tokens binary")
    for form in schematics.FORMATS:
        rows = {r[0]: r.schematic for r in schematics.with_schematic(df, "tokens", form=form).collect()}
        assert rows[2] is None and schematics.FORMATS[form][2](bytes(rows[1]))[3] == [schematics.STATES[t] for t in GRID]
