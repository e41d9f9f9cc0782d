"""python -m tidewarden REQUESTS OUT: answers a JSON-lines file of requests, in order, with a JSON-lines folder.

python -m tidewarden serve FOLDER OUT: answers the files that come into a folder, as a stream, into the table OUT/answers (with
--once those that are there); OUT also holds the store and the stream's state, so it goes on where it ended.
python -m tidewarden write TEXT: the verdict on one write. python -m tidewarden read QUERY: what a read finds after the query
itself was written.

--detector KIND --protected GLOBS --immutable GLOBS set the policy. A request's time is its field `at` (seconds), else now.
"""

import argparse
import json
import sys


def policy_of(a: argparse.Namespace):
    from tidewarden.functions import detect, patterns
    from tidewarden.operators import gate

    return gate.Policy(patterns.pattern_list(a.protected), patterns.pattern_list(a.immutable), detector=detect.detector(a.detector))


def answered(lines, policy):
    """seq and value of each line's answer (lines: seq, secs, value)."""
    from pyspark.sql import functions as F

    from tidewarden.plans import dispatch
    from tidewarden.sources import jsonl

    good, bad = jsonl.requests(lines)
    return dispatch.responses(good, policy).unionByName(bad.select("seq", F.to_json(F.struct(F.struct("code", "message", "retryable").alias("error"))).alias("value")))


def one(spark, policy, ops: list[dict]) -> str:
    """The last answer to a few requests."""
    lines = spark.createDataFrame([(i, i, json.dumps(op)) for i, op in enumerate(ops)], "seq long, secs long, value string")
    return max(answered(lines, policy).collect())["value"]


def batch(spark, policy, requests: str, out: str) -> None:
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    lines = spark.read.text(requests).where(F.trim("value") != "").withColumn("_at", F.monotonically_increasing_id())
    own = F.expr("try_variant_get(try_parse_json(value), '$.at', 'double')").cast("long")
    # Files are read in order; one command's requests are few, and their order is theirs to give.
    lines = lines.select("value", F.row_number().over(Window.orderBy("_at")).cast("long").alias("seq"), F.coalesce(own, F.unix_timestamp()).alias("secs"))
    answered(lines, policy).orderBy("seq").select("value").coalesce(1).write.mode("overwrite").text(out)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    argv = list(sys.argv[1:] if argv is None else argv)
    command = argv.pop(0) if argv and argv[0] in ("serve", "write", "read") else "batch"
    args = argparse.ArgumentParser(prog="tidewarden", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    for name in {"batch": ("requests", "out"), "serve": ("folder", "out")}.get(command, ("text",)):
        args.add_argument(name)
    args.add_argument("--once", action="store_true")
    args.add_argument("--detector", default="native")
    args.add_argument("--protected", default="")
    args.add_argument("--immutable", default="")
    a = args.parse_args(argv)
    policy = policy_of(a)
    spark = SparkSession.builder.appName("tidewarden").getOrCreate()
    write = {"op": "validate_write", "entry": getattr(a, "text", "")}
    if command == "batch":
        batch(spark, policy, a.requests, a.out)
    elif command == "serve":
        from tidewarden.streaming import requests

        requests.served(spark, a.folder, a.out, f"{a.out}/state", policy, **({"availableNow": True} if a.once else {})).awaitTermination()
    elif command == "write":
        print(one(spark, policy, [write]))
    else:
        print(one(spark, policy, [write, {"op": "validate_read", "query": a.text}]))


if __name__ == "__main__":
    main()
