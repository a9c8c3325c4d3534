"""Command line: ``python -m tributary run | replay | sample | inject | similar | load``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tributary.config import LoaderConfig, LSHConfig, ProducerConfig, SourceConfig
from tributary.operators import duplicates, lsh
from tributary.schemas import PAYLOAD
from tributary.session import build_session
from tributary.sources import reviews, sinks
from tributary.streaming.pipelines import start_pipeline


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tributary", description=__doc__)
    sub = parser.add_subparsers(dest="task", required=True)
    run = sub.add_parser("run", help="all streaming queries, from the topic or from JSON files in a folder, until one ends")
    run.add_argument("--path", help="folder of JSON lines in place of the topic")
    run.add_argument("--root", help="folder of all tables in place of the configured sinks")
    run.add_argument("--once", action="store_true", help="take what is there and stop")
    replay = sub.add_parser("replay", help="publish JSON lines to the topic")
    replay.add_argument("--source")
    sample = sub.add_parser("sample", help="some lines of a file of JSON lines")
    inject = sub.add_parser("inject", help="a file of JSON lines with copies of some of them, in random order")
    for p in (sample, inject):
        p.add_argument("--source", required=True)
        p.add_argument("--destination", required=True)
        p.add_argument("--seed", type=int, default=7)
    sample.add_argument("--records", type=int, default=100_000)
    sample.add_argument("--method", choices=["head", "reservoir"], default="head")
    inject.add_argument("--duplicate-fraction", type=float, default=0.1)
    similar = sub.add_parser("similar", help="the batch of similar reviews and private frequencies")
    similar.add_argument("--source")
    load = sub.add_parser("load", help="append the reported tables to the reporting database")
    load.add_argument("--folder", default="delta")
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    given = arguments().parse_args(argv)
    if getattr(given, "duplicate_fraction", 0) < 0:
        raise SystemExit("--duplicate-fraction must not be negative")
    spark = spark or build_session()
    if given.task == "run":
        source = SourceConfig.from_env()
        path = given.path or source.path
        messages = reviews.file_stream(spark, path, "value string", "text") if path else reviews.kafka_stream(spark, source.servers, source.topic, source.starting)
        pipeline = start_pipeline(reviews.parse_messages(messages), given.root, trigger=None if given.once else source.trigger)
        if given.once:
            for q in pipeline.queries:
                q.awaitTermination()
            pipeline.stop()
        else:
            pipeline.wait()
    elif given.task == "replay":
        source = SourceConfig.from_env()
        sinks.replay(spark.read.schema(PAYLOAD).json(given.source or ProducerConfig.from_env().source_file), servers=source.servers, topic=source.topic)
    elif given.task == "sample":
        take = reviews.head_lines(spark, given.source, given.records) if given.method == "head" else reviews.sample_lines(spark, given.source, given.records, given.seed)
        take.write.mode("overwrite").text(given.destination)
    elif given.task == "inject":
        lines = spark.read.text(given.source).where("trim(value) <> ''")
        duplicates.shuffled(duplicates.inject_exactly(lines, given.duplicate_fraction, given.seed), given.seed).write.mode("overwrite").text(given.destination)
    elif given.task == "similar":
        config = LSHConfig.from_env()
        if given.source:
            config.source_path = given.source
        lsh.run(lsh.load_reviews(spark, config), config)
    else:
        loader = LoaderConfig.from_env()
        for name, told in sinks.load_all(spark, given.folder, sinks.jdbc_writer(loader.url(), loader.user, loader.password)).items():
            print(f"{name}: {told}")


if __name__ == "__main__":
    main()
