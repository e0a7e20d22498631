"""Thin command line: ``python -m ranklore.cli COMMAND ...`` or with spark-submit."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def _positive(text: str) -> int:
    value = int(text)
    if value < 1:
        raise argparse.ArgumentTypeError(f"{text} is not a positive number")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ranklore", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *options: tuple) -> None:
        p = sub.add_parser(name, help=text)
        for flag, kw in options:
            p.add_argument(flag, **kw)

    src, out, key = ("--input", {"required": True}), ("--output", {"required": True}), ("--key", {"required": True})
    bits = ("--bits", {"type": _positive, "default": 64})
    add("fit-index", "train a learned index over a key column", src, out, key, ("--spec", {"default": "linear,linear"}), ("--branch", {"type": _positive, "default": 64}))
    add("predict", "positions of keys by a trained index", src, out, key, ("--model", {"required": True}), ("--limit", {"type": _positive}))
    add("fit-hash", "train a hash of a key column", src, out, key, bits, ("--spec", {}), ("--branch", {"type": _positive}), ("--scale", {"type": float, "default": 1.0}), ("--max-bytes", {"type": _positive}))
    add("hash", "hash keys by a trained hash", src, out, key, ("--model", {"required": True}))
    add("fit-vectors", "train a vector hash", src, out, bits, ("--k", {"type": _positive, "required": True}), ("--knn", {"type": _positive, "default": 32}), ("--spec", {"default": "linear,linear"}), ("--leaves", {"type": _positive, "default": 32}))
    add("hash-vectors", "hash vectors by a trained vector hash", src, out, ("--model", {"required": True}))
    add("evaluate", "locality metrics of a vector hash", src, ("--model", {"required": True}), ("--neighbours", {"type": _positive, "default": 10}), ("--every", {"type": _positive, "default": 100}))
    add("select", "search a vector hash configuration", src, bits, ("--seconds", {"type": float}), ("--trains", {"type": _positive}), ("--every", {"type": _positive, "default": 100}))
    add("select-contexts", "search configurations over skeletons of several sizes and write a report", src, out, bits, ("--targets", {"type": _positive, "nargs": "*"}), ("--profile", {"default": "auto"}), ("--recall", {"action": "store_true"}), ("--seconds", {"type": float}), ("--trains", {"type": _positive}), ("--every", {"type": _positive, "default": 100}))
    add("build-vectors", "build a vector index from a description and save it", src, out, ("--index", {"required": True}))
    add("search-vectors", "search a saved vector index", src, out, ("--model", {"required": True}), ("--k", {"type": _positive, "default": 10}), ("--probes", {"type": _positive}), ("--ef", {"type": _positive}))
    add("export-sql", "a trained learned index as SQL expressions", ("--model", {"required": True}), key)
    add("materialise", "xbin base and queries to a checked dataset with exact neighbours", src, out, ("--queries", {"required": True}), ("--name", {"required": True}), ("--k", {"type": _positive, "default": 100}), ("--rows", {"type": _positive}))
    add("verify-bundle", "check a bundle's tables against its manifests", src)
    add("convert", "xbin to Parquet", src, out, ("--first", {"type": _positive}))
    return top


def run(spark: SparkSession, args: argparse.Namespace):
    from ranklore.operators import evaluation as E
    from ranklore.operators import export as EX
    from ranklore.operators import indexes as IX
    from ranklore.operators import learned as L
    from ranklore.operators import scalar_hash as H
    from ranklore.operators import search as S
    from ranklore.operators import selection as SN
    from ranklore.operators import selector as SEL
    from ranklore.operators import vector_hash as VH
    from ranklore.operators.store import load_index, save_index
    from ranklore.sources import binary as B
    from ranklore.sources import materialise as MT
    from ranklore.sources import models as MD
    from ranklore.sources import reports as RP

    if args.command == "convert":
        return B.convert_xbin(spark, args.input, args.output, args.first).count()
    if args.command == "export-sql":
        return json.dumps(EX.index_sql(MD.load_index(spark, args.model), args.key))
    if args.command == "materialise":
        return json.dumps(MT.materialise(spark, args.name, args.input, args.queries, args.output, args.k, args.rows))
    if args.command == "verify-bundle":
        return json.dumps(MT.verify_bundle(spark, args.input))
    df = spark.read.parquet(args.input)
    if args.command == "build-vectors":
        save_index(IX.index_factory(args.index).fit(df).add(df), args.output, spark)
    elif args.command == "search-vectors":
        asked = {name: value for name in ("probes", "ef") if (value := getattr(args, name)) is not None}
        load_index(args.model, spark).search(df, args.k, **asked).write.mode("overwrite").parquet(args.output)
    elif args.command == "select-contexts":
        options = SEL.Options(bits=args.bits, profile=args.profile, for_recall=args.recall, seconds=args.seconds, max_trains=args.trains)
        RP.write_selection(spark, SN.search(df, df.filter(F.col("vec_id") % args.every == 0), options, args.targets).as_dict(), args.output)
    elif args.command == "fit-index":
        MD.save_index(L.train(df, args.key, args.spec, args.branch), args.output)
    elif args.command == "predict":
        MD.write_predictions(MD.load_index(spark, args.model).predict(df, args.key), args.key, args.output, args.limit)
    elif args.command == "fit-hash":
        MD.save_scalar_hash(H.fit_scalar_hash(df, args.key, args.spec, args.branch, args.bits, args.scale, max_bytes=args.max_bytes), args.output)
    elif args.command == "hash":
        model = MD.load_scalar_hash(spark, args.model)
        MD.write_hashes(model.apply(df, args.key), args.key, args.output, model.mapping.bits)
    elif args.command == "fit-vectors":
        MD.save_vector_hash(VH.fit_vector_hash(df, args.k, args.bits, args.knn, args.spec, args.leaves), spark, args.output)
    elif args.command == "hash-vectors":
        MD.load_vector_hash(spark, args.model).apply(df).select("vec_id", "hash_hex").write.mode("overwrite").csv(args.output, header=True)
    else:
        queries = df.filter(F.col("vec_id") % args.every == 0)
        if args.command == "select":
            found = SEL.select(df, queries, SEL.Options(bits=args.bits, seconds=args.seconds, max_trains=args.trains))
            return json.dumps(found.as_dict())
        model = MD.load_vector_hash(spark, args.model)
        base = model.apply(df).select("vec_id", F.col("hash" if model.bits <= 64 else "hash_hex").alias("hash"))
        truth = S.knn(queries, df, args.neighbours, exclude_self=True)
        row = E.evaluate(base, base.join(queries.select("vec_id"), "vec_id", "left_semi"), truth, model.bits, [], list(E.NODE_COUNTS)).first()
        return json.dumps(row.asDict())
    return args.output


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName(f"ranklore {args.command}").getOrCreate()
    print(run(spark, args))


if __name__ == "__main__":
    main()
