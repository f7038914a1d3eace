"""Sources, bundles, streaming, the pipeline object, the command line and the registry."""

import json
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellweave import cli, names
from cellweave.pipeline import Pipeline
from cellweave.sources import bundle, images, tables, validate
from cellweave.sources.example import example_census
from cellweave.streaming import census_stream


def test_names():
    assert names.natural_sort(["O1.10", "O1.2", "S1.1", "O1.1"]) == ["O1.1", "O1.2", "O1.10", "S1.1"]
    assert names.radius_key(2.0) == "2" and names.radius_key(1.1) == "1.1"
    assert names.image_group("O12") == ("O", 12) and names.parse_variable("O1.3_S2.4") == {"object_map": 1, "object": 3, "scalar_map": 2, "channel": 4}
    with pytest.raises(ValueError):
        names.image_group("X1")


@pytest.mark.parametrize("kind", ["csv", "tsv", "parquet"])
def test_tables_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame([(1.0, 2.0, 3), (4.0, 5.0, 6)], "x double, y double, object_id int")
    path = str(tmp_path / f"t.{kind}")
    tables.write_table(df, path)
    assert sorted(map(tuple, tables.read_table(spark, path).collect())) == [(1.0, 2.0, 3), (4.0, 5.0, 6)]
    assert tables.load_coordinate_table(spark, path).count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_table(df, path)


def test_table_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.read_table(spark, "a.xyz")
    with pytest.raises(FileNotFoundError):
        tables.read_table(spark, str(tmp_path / "no.csv"))


def test_links_and_profiles(spark, tmp_path):
    (tmp_path / "l.csv").write_text("name,S1.1,S1.2\nO1.1,1,0\nO1.2,1,1\n")
    assert tables.load_table(spark, str(tmp_path / "l.csv"), "L") == [("O1.1", "S1.1"), ("O1.2", "S1.1"), ("O1.2", "S1.2")]
    assert tables.label_links([[1, 0], [0, 1]], [1, 2]) == [("O1.1", "S1.1"), ("O1.2", "S1.2")]
    (tmp_path / "o.csv").write_text("X,Y,Object\n1,2,3\n")
    assert tables.load_table(spark, str(tmp_path / "o.csv"), "O").columns == ["X", "Y", "Z", "Object"]
    (tmp_path / "p.csv").write_text("Object,Count,a\n1,1,0.5\n2,3,0.7\n")
    labels = images.array_voxels(spark, "O1", np.array([[1, 1], [1, 2]]))
    got = tables.load_table(spark, str(tmp_path / "p.csv"), "P", labels).collect()
    assert [(r["Object"], r["Count"]) for r in got] == [(1, 3), (2, 1)]
    at = spark.createDataFrame([(1, 2, 2, 0.5), (2, 1, 1, 0.7)], "Object long, X long, Y long, a double")
    assert [(r["Object"], r["a"]) for r in tables.profile_by_coordinates(at, labels).collect()] == [(1, 0.7), (2, 0.5)]


def test_tiff(spark, tmp_path):
    page = np.array([[[0, 0, 0], [255, 0, 0]], [[0, 0, 255], [255, 0, 0]]], np.uint8)
    (tmp_path / "a.tif").write_bytes(images.write_tiff([page]))
    voxels, palette = images.load_object_image(spark, str(tmp_path / "a.tif"))
    assert palette == ["#0000FF", "#FF0000"]
    assert images.voxel_array(voxels, (2, 2, 1))[:, :, 0].tolist() == [[0, 2], [1, 2]]
    (tmp_path / "s.tif").write_bytes(images.write_tiff([np.full((1, 1), k, np.uint8) for k in (1, 2, 3, 4)]))
    got = {(r["z"], r["c"]): r["value"] for r in images.load_scalar_image(spark, str(tmp_path / "s.tif"), 2).collect()}
    assert got == {(0, 1): 1, (0, 2): 2, (1, 1): 3, (1, 2): 4}
    assert [r["value"] for r in images.load_scalar_image(spark, str(tmp_path / "s.tif"), 2, keep=[2]).orderBy("z").collect()] == [2, 4]
    with pytest.raises(FileNotFoundError):
        images.load_object_image(spark, str(tmp_path / "none.tif"))


def png(array):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = array.shape
    lines = b""
    for y in range(h):
        method = y % 5
        row, above = array[y].astype(int), array[y - 1].astype(int) if y else np.zeros(w, int)
        out = []
        for x in range(w):
            a, b, c = row[x - 1] if x else 0, above[x], above[x - 1] if x else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((row[x] - [0, a, b, (a + b) // 2, paeth][method]) % 256)
        lines += bytes([method, *out])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_png():
    array = np.random.default_rng(1).integers(0, 256, (11, 7)).astype(np.uint8)
    assert (images.png_array(png(array)) == array).all()
    assert images._packbits(bytes([2, 1, 2, 3, 254, 9, 128])) == bytes([1, 2, 3, 9, 9, 9])


def tiff(blocks, tags, end="<"):
    """A one-page TIFF: blocks of bytes, and tags {tag: (type, values)} besides their places."""
    out, places = bytearray((b"II*\0" if end == "<" else b"MM\0*") + b"\0" * 4), []
    for block in blocks:
        places.append(len(out))
        out += block
    tiled = 322 in tags
    tags = tags | {324 if tiled else 273: (4, places), 325 if tiled else 279: (4, [len(b) for b in blocks])}
    fields = b""
    for tag, (kind, values) in sorted(tags.items()):
        body = struct.pack(f"{end}{len(values)}{'BHI'[[1, 3, 4].index(kind)]}", *values)
        if len(body) > 4:
            body, place = struct.pack(end + "I", len(out)), body
            out += place
        fields += struct.pack(end + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
    struct.pack_into(end + "I", out, 4, len(out))
    return bytes(out + struct.pack(end + "H", len(tags)) + fields + b"\0" * 4)


def lzw(raw):
    codes, width, bits = {bytes([k]): k for k in range(256)}, 9, ""
    put = lambda c: format(c, f"0{width}b")
    bits += put(256)
    size, word = 258, b""
    for k in range(len(raw)):
        longer = word + raw[k : k + 1]
        if longer in codes:
            word = longer
            continue
        bits += put(codes[word])
        codes[longer], size = size, size + 1
        width = min(12, max(9, size.bit_length()))
        if size == 4095:
            bits += put(256)
            codes, width, size = {bytes([j]): j for j in range(256)}, 9, 258
        word = raw[k : k + 1]
    bits += put(codes[word]) + format(257, f"0{min(12, max(9, (size + 1).bit_length()))}b")
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("end", ["<", ">"])
def test_tiff_layouts(end):
    rng = np.random.default_rng(5)
    rgb, gray = rng.integers(0, 256, (37, 21, 3)).astype(np.uint8), (rng.integers(0, 3, (150, 90)) * 100).astype(f"{end}u2")
    base = lambda a, bits: {256: (4, [a.shape[1]]), 257: (4, [a.shape[0]]), 258: (3, [bits]), 277: (3, [1 if a.ndim == 2 else a.shape[2]])}
    read = lambda *a: images.tiff_pages(tiff(*a, end))[0]
    strips = [rgb[k : k + 10].tobytes() for k in range(0, 37, 10)]
    assert (read(strips, base(rgb, 8) | {278: (4, [10])}) == rgb).all()
    planes = [rgb[:, :, c].tobytes() for c in range(3)]
    assert (read(planes, base(rgb, 8) | {284: (3, [2])}) == rgb).all()
    padded = np.zeros((48, 32, 3), np.uint8)
    padded[:37, :21] = rgb
    tiles = [padded[y : y + 16, x : x + 16].tobytes() for y in range(0, 48, 16) for x in range(0, 32, 16)]
    assert (read(tiles, base(rgb, 8) | {322: (4, [16]), 323: (4, [16])}) == rgb).all()
    assert (read([lzw(gray.tobytes())], base(gray, 16) | {259: (3, [5])}) == gray).all()
    steps = np.diff(rgb, axis=1, prepend=np.zeros((37, 1, 3), np.uint8)).astype(np.uint8)
    assert (read([zlib.compress(steps.tobytes())], base(rgb, 8) | {259: (3, [8]), 317: (3, [2])}) == rgb).all()
    share = rng.random((5, 4)).astype(f"{end}f4")
    assert (read([share.tobytes()], base(share, 32) | {339: (3, [3])}) == np.rint(share * 255)).all()
    with pytest.raises(ValueError, match="shares"):
        read([(share * 9).tobytes()], base(share, 32) | {339: (3, [3])})
    colors = rng.integers(0, 256, (256, 3)) * 257
    at = rng.integers(0, 256, (6, 5)).astype(np.uint8)
    assert (read([at.tobytes()], base(at, 8) | {262: (3, [3]), 320: (3, colors.T.ravel().tolist())}) == (colors >> 8)[at]).all()
    with pytest.raises(ValueError, match="compression 7"):
        read([b""], base(at, 8) | {259: (3, [7])})


def png_of(rows, width, height, bits, color, interlace=0, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, bits, color, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + extra + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r for r in rows))) + chunk(b"IEND", b"")


def packed(line, bits):
    text = "".join(format(v, f"0{bits}b") for v in line)
    return int(text.ljust(-(-len(text) // 8) * 8, "0"), 2).to_bytes(-(-len(text) // 8), "big")


@pytest.mark.parametrize("bits", [1, 2, 4, 8, 16])
def test_png_depths_and_passes(bits):
    array = np.random.default_rng(bits).integers(0, 2**bits, (13, 11))
    scale = 1 if bits >= 8 else 255 // (2**bits - 1)
    assert (images.png_array(png_of([packed(r, bits) for r in array], 11, 13, bits, 0)) == array * scale).all()
    rows = []
    for x, y, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        rows += [packed(r, bits) for r in array[y::dy, x::dx]]
    assert (images.png_array(png_of(rows, 11, 13, bits, 0, 1)) == array * scale).all()
    if bits <= 4:
        colors = np.random.default_rng(9).integers(0, 256, (2**bits, 3)).astype(np.uint8)
        plte = struct.pack(">I", colors.size) + b"PLTE" + colors.tobytes() + b"\0" * 4
        assert (images.png_array(png_of([packed(r, bits) for r in array], 11, 13, bits, 3, extra=plte)) == colors[array]).all()


def test_bundles(spark, tmp_path):
    result = {"table": example_census(spark), "array": np.arange(6.0).reshape(2, 3), "nan": float("nan"), "pair": (1, "a")}
    bundle.save_result(result, str(tmp_path / "b"))
    got = bundle.load_result(spark, str(tmp_path / "b"))
    assert got["table"].count() == 40 and got["array"].shape == (2, 3) and got["pair"] == (1, "a") and got["nan"] != got["nan"]
    with pytest.raises(FileExistsError):
        bundle.save_result(result, str(tmp_path / "b"))
    manifest = json.loads((tmp_path / "b/manifest.json").read_text())
    manifest["content"]["table"]["$table"] = "../../x.parquet"
    (tmp_path / "b/manifest.json").write_text(json.dumps(manifest))
    with pytest.raises(ValueError, match="inside"):
        bundle.load_result(spark, str(tmp_path / "b"))
    with pytest.raises(TypeError):
        bundle.save_result({1: 2}, str(tmp_path / "c"))
    with pytest.raises(ValueError):
        bundle.load_data(spark, "a.pkl")
    assert not (tmp_path / "c").exists()


def test_validation(spark):
    good = validate.validate(example_census(spark))
    assert good["valid"] and good["type"] == "census" and good["rows"] == 40 and good["radii"] == {10.0: 20, 20.0: 20}
    bad = validate.validate(spark.createDataFrame([("a",)], "x string"))
    assert not bad["valid"] and len(bad["errors"]) >= 2
    with pytest.raises(ValueError):
        validate.validate(np.zeros(3), raise_on_error=True)


def test_stream_census(spark, tmp_path):
    points = spark.createDataFrame([(float(k), 0.0, 0.0, 1 + k % 2) for k in range(10)], "x double, y double, z double, object long").withColumn("s", F.array().cast("array<double>"))
    spark.createDataFrame([(1, 2.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0)], "nbhd int, x double, y double, z double").write.parquet(str(tmp_path / "in"))
    seeds = spark.readStream.schema("nbhd int, x double, y double, z double").parquet(str(tmp_path / "in"))
    census_stream.census_stream(seeds, points, 1.0, [1, 2], ["nbhd"], str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = {r["nbhd"]: (round(r["O1.1"], 3), round(r["O1.2"], 3)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (33.333, 66.667), 2: (66.667, 33.333)}


def test_pipeline_object(spark, tmp_path):
    rows = [(float(k % 7), float(k // 7), 1 + k % 3, float(k % 5)) for k in range(140)]
    table = spark.createDataFrame(rows, "x double, y double, object_id long, marker double")
    steps = []
    p = Pipeline(spark, lambda name, part: steps.append(name)).load_table(table).set_parameters(radii=1.5)
    census = p.census(object_column="object_id", variables=["marker"], sample_size=40)
    assert census.count() == 40 and p.variables == ["O1.1", "O1.2", "O1.3", "marker"]
    assert p.measure_cis_mi(2, bootstraps=2).count() == 6
    p.learn_patterns(["O1.1", "O1.2"], 1.5, rounds=1, smooth_window=0)
    p.save(str(tmp_path / "run"))
    again = Pipeline(spark).load(str(tmp_path / "run"))
    assert again.get_results("pattern").count() == 80 and steps[0] == "load_table" and again.state.log[0]["operation"] == "load_table"
    with pytest.raises(KeyError):
        p.get_results("nothing")


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("x,y,object_id,marker\n" + "".join(f"{k % 6}.0,{k // 6}.0,{1 + k % 2},{k % 4}.0\n" for k in range(60)))
    source, out = str(tmp_path / "t.csv"), str(tmp_path / "census.parquet")
    assert cli.main(["census", source, out, "--radii", "1,2", "--variables", "marker", "--object-column", "object_id"], spark) == 0
    assert spark.read.parquet(out).count() == 120
    assert cli.main(["analyze", out, str(tmp_path / "mi.parquet"), "--bootstraps", "2"], spark) == 0
    assert cli.main(["plot", str(tmp_path / "mi.parquet"), str(tmp_path / "rank.csv"), "--radius", "1", "--p", "1", "--mi", "0"], spark) == 0
    assert cli.main(["convert", source, out], spark) == 2 and "error" in capsys.readouterr().err


def test_registry(spark, sf_dir):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 60
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name in ("census_points_r1", "weights_queen", "random_census_overlap", "smooth_dist_2d"):
        got = found[name](spark, sf_dir)
        columns = sorted(got.columns)
        expected = con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({sql[name]})").fetchall()
        assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, expected)), name
    assert __spark_entry__.entry(spark).count() > 0


def test_cli_images_maps_and_several_tables(spark, tmp_path):
    rng = np.random.default_rng(2)
    label = rng.integers(0, 3, (12, 10))
    colors = np.array([[0, 0, 0], [255, 0, 0], [0, 0, 255]], np.uint8)
    objects, scalars = str(tmp_path / "o.tif"), str(tmp_path / "s.tif")
    (tmp_path / "o.tif").write_bytes(images.write_tiff([colors[label]]))
    (tmp_path / "s.tif").write_bytes(images.write_tiff([rng.integers(0, 256, (12, 10)), rng.integers(0, 256, (12, 10))]))
    out = str(tmp_path / "census.parquet")
    assert cli.main(["image", f"O1={objects}", f"S1={scalars}:2", out, "--radii", "1,2", "--sample-size", "9", "--links", "O1.1:S1.1"], spark) == 0
    census = spark.read.parquet(out)
    assert census.count() == 18 and {"O1.1", "O1.2", "O1.1_S1.1", "X", "Radius"} <= set(census.columns)
    path = str(tmp_path / "path.csv")
    tables.write_table(spark.createDataFrame([(float(x), float(x), "O1.1") for x in (0, 50, 100)], "X double, Y double, V string"), path)
    mapped = str(tmp_path / "map.parquet")
    assert cli.main(["map", path, mapped, "--census", out, "--image", objects, "--bounds", "0:40,60:100", "--radius", "2", "--axes", "2,2,1", "--palette", "#FF0000,#00FF00"], spark) == 0
    assert spark.read.parquet(mapped).count() == (label > 0).sum()
    for k in range(3):
        tables.write_table(spark.range(60).selectExpr(f"double(id * {k + 3} % 7) as `S1.1`", f"double(id % {k + 2}) as `S1.2`", "1.0D as Radius"), str(tmp_path / f"c{k}.parquet"))
    three = ",".join(str(tmp_path / f"c{k}.parquet") for k in range(3))
    assert cli.main(["analyze", three, str(tmp_path / "trans.parquet"), "--type", "transmi", "--groups", "a,b,a", "--bootstraps", "3"], spark) == 0
    assert "TransMI" in spark.read.parquet(str(tmp_path / "trans.parquet")).columns
