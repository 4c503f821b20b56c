"""Command line: ``python -m apportion <study> --input DIR --output DIR``."""

from __future__ import annotations

import argparse

from apportion import jobs
from apportion.operators.scoring import linear_model, load_weights, prototype_model
from apportion.session import build_session
from apportion.sources import event_samples, vector_samples
from apportion.sources.tables import EVENT_SECONDS_PER_STREAM_SECOND


def numbers(text: str) -> list[int]:
    return [int(part) for part in text.split(",") if part.strip()]


def main() -> None:
    parser = argparse.ArgumentParser(prog="apportion", description=__doc__)
    parser.add_argument("study", choices=["batch-matrix", "streaming-matrix", "measured-suite"])
    parser.add_argument("--input", required=True, help="folder of Parquet tables")
    parser.add_argument("--output", required=True, help="folder for result files")
    parser.add_argument("--workers", type=numbers, default=[1, 2, 4])
    parser.add_argument("--rates", type=numbers, default=[100, 250, 500, 750, 1000])
    parser.add_argument("--samples", type=int, default=None, help="use at most the first N samples")
    parser.add_argument("--batch-size", type=int, default=128)
    parser.add_argument("--runs", type=int, default=3)
    parser.add_argument("--cores", type=int, default=None, help="run locally on this many cores")
    args = parser.parse_args()
    spark = build_session(cores=args.cores)
    scale = EVENT_SECONDS_PER_STREAM_SECOND
    if args.study == "batch-matrix":
        samples = event_samples(spark, args.input)
        jobs.batch_matrix(
            samples, "seq", args.output, args.workers, args.batch_size, args.samples, scale
        ).filter("scope = 'aggregate'").show()
    elif args.study == "streaming-matrix":
        samples = event_samples(spark, args.input)
        experiments = jobs.streaming_matrix(
            samples,
            args.output,
            worker_counts=args.workers,
            rates=args.rates,
            max_samples=args.samples,
            time_scale=scale,
        )
        experiments.select(
            "strategy", "num_workers", "stream_rate", "total_processed", "efficiency", "error"
        ).orderBy("num_workers", "strategy", "stream_rate").show(100)
    else:
        samples = vector_samples(spark, args.input)
        _, weights = load_weights(prototype_model(samples))
        for workers in args.workers:
            jobs.measured_suite(
                samples,
                linear_model(weights),
                f"{args.output}/workers={workers}",
                workers,
                args.runs,
                args.batch_size,
            ).show(50, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
