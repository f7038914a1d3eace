"""Command line: census, image, analyze, map, plot (tables behind plots), convert. Exit 0, 2 for wrong input, 1 for a failure."""

from __future__ import annotations

import argparse
import re
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def numbers(text: str) -> list[float]:
    """Comma-separated numbers."""
    out = [float(p) for p in text.split(",") if p.strip()]
    if not out:
        raise ValueError("a comma-separated list of numbers is needed")
    return out


def names(text: str | None) -> list[str]:
    return [p.strip() for p in (text or "").split(",") if p.strip()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellweave", description="Spatial patterning on Spark")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("census", help="census of a coordinate table")
    one.add_argument("input")
    one.add_argument("output")
    one.add_argument("--radii", required=True, type=numbers)
    one.add_argument("--variables", default="")
    one.add_argument("--object-column")
    one.add_argument("--sample-size", type=int)
    one.add_argument("--seed", type=int, default=0)
    two = commands.add_parser("analyze", help="information or patterns of a census")
    two.add_argument("input")
    two.add_argument("output")
    two.add_argument("--type", choices=["cismi", "transmi", "pattern"], default="cismi", help="transmi takes several tables, comma-separated, and their groups")
    two.add_argument("--groups", default="")
    two.add_argument("--depth", type=int, default=2)
    two.add_argument("--bootstraps", type=int, default=100)
    two.add_argument("--variables", default="")
    two.add_argument("--radius", type=float)
    two.add_argument("--seed", type=int, default=0)
    three = commands.add_parser("plot", help="the table behind a plot")
    three.add_argument("input")
    three.add_argument("output")
    three.add_argument("--type", choices=["rank", "radius", "distribution", "covariation"], default="rank")
    three.add_argument("--variables", default="")
    three.add_argument("--radius", type=float)
    three.add_argument("--p", type=float, default=0.05)
    three.add_argument("--mi", type=float)
    three.add_argument("--bins", type=int)
    five = commands.add_parser("image", help="census of images: O1=objects.tif S1=scalars.tif:2 (two channels)")
    five.add_argument("input", nargs="+")
    five.add_argument("output")
    five.add_argument("--radii", required=True, type=numbers)
    five.add_argument("--sample-size", type=int, required=True)
    five.add_argument("--links", default="", help="O1.2:S1.1, comma-separated")
    five.add_argument("--seed", type=int, default=0)
    six = commands.add_parser("map", help="a covariation table's regions put back onto an object image")
    six.add_argument("input")
    six.add_argument("output")
    six.add_argument("--census", required=True)
    six.add_argument("--image", required=True)
    six.add_argument("--bounds", required=True, help="0:40,60:100")
    six.add_argument("--radius", required=True, type=float)
    six.add_argument("--axes", required=True, type=numbers)
    six.add_argument("--palette", required=True)
    four = commands.add_parser("convert", help="a table from one format to another")
    four.add_argument("input")
    four.add_argument("output")
    return top


def image_census(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """The census of the named images; a scalar image tells its channels behind a colon."""
    from cellweave.names import image_group
    from cellweave.operators.image import census_image
    from cellweave.sources.images import load_object_image, load_scalar_image

    voxels = None
    for given in args.input:
        name, _, path = given.partition("=")
        if image_group(name)[0] == "O":
            own = load_object_image(spark, path, name)[0]
        else:
            path, channels = re.fullmatch(r"(.*?)(?::(\d+))?", path).groups()
            own = load_scalar_image(spark, path, int(channels or 1), name)
        voxels = own if voxels is None else voxels.unionByName(own)
    links = [tuple(pair.split(":")) for pair in names(args.links)]
    return census_image(voxels, args.radii, args.sample_size, links, random_state=args.seed)[0]


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    from cellweave.operators import mutual_information as mi
    from cellweave.operators import patterns, viewdata
    from cellweave.operators.census import census_coordinates
    from cellweave.sources.images import load_object_image
    from cellweave.sources.tables import exists, load_coordinate_table, read_table, write_table

    if exists(spark, args.output):
        raise FileExistsError(args.output)
    if args.command == "image":
        out = image_census(spark, args)
    elif args.command == "map":
        labels = load_object_image(spark, args.image)[0]
        bounds = [[float(v) for v in pair.split(":")] for pair in names(args.bounds)]
        out = patterns.map_pattern(read_table(spark, args.input), bounds, labels, read_table(spark, args.census), args.radius, args.axes, names(args.palette))[0]
    elif args.command == "census":
        table = load_coordinate_table(spark, args.input)
        out = census_coordinates(table, args.radii, names(args.variables) or None, object_column=args.object_column, sample_size=args.sample_size, random_state=args.seed).drop("nbhd")
    elif args.command == "convert":
        out = read_table(spark, args.input)
    elif args.command == "analyze" and args.type == "transmi":
        out = mi.measure_trans_mi([read_table(spark, p) for p in names(args.input)], {"Group": names(args.groups)}, args.depth, bootstraps=args.bootstraps, random_state=args.seed)
    else:
        data, wanted = read_table(spark, args.input), names(args.variables)
        if args.command == "analyze" and args.type == "cismi":
            out = mi.measure_cis_mi(data, args.depth, bootstraps=args.bootstraps, random_state=args.seed, allow_permutation=True)
        elif args.command == "analyze":
            out = patterns.learn_pattern(data, wanted, args.radius, random_state=args.seed)[0]
        elif args.type == "rank":
            out = viewdata.mi_rank(data, args.radius, p_threshold=args.p, mi_threshold=args.mi)[1]
        elif args.type == "radius":
            out = viewdata.mi_by_radius(data, wanted)
        elif args.type == "distribution":
            out = viewdata.distribution(data, wanted, args.radius, args.bins)
        else:
            out = data.select("V", "X", "Y", "Ymin", "Ymax")
    write_table(out, args.output)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from cellweave.session import session

        spark = session()
    try:
        run(spark, args)
    except (ValueError, TypeError, FileNotFoundError, FileExistsError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    except Exception as error:  # noqa: BLE001
        print(f"failed: {error}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
