"""Folder jobs for spark-submit: ``wellspring/jobs.py flag --input DIR --output DIR ...``

The folders default to the variables INPUT_DIR and OUTPUT_DIR.
"""

from __future__ import annotations

import argparse
import os

from wellspring.plans import folder_jobs
from wellspring.plans.processing import ProcessingConfig, process_file
from wellspring.plans.quality import save_report
from wellspring.session import build_session
from wellspring.sources.writers import write_parquet


def arguments(words: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Jobs over a folder of well files")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("process", "flag", "split-outliers", "disturb"):
        job = jobs.add_parser(name)
        job.add_argument("--input", default=os.environ.get("INPUT_DIR"))
        job.add_argument("--output", default=os.environ.get("OUTPUT_DIR"))
        job.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append"])
        if name == "process":
            job.add_argument("--strategy", default="median")
            job.add_argument("--outlier-method", default="isolation_forest")
        if name == "split-outliers":
            job.add_argument("--columns", nargs="+")
            job.add_argument("--z-threshold", type=float, default=3.0)
            job.add_argument("--iqr-multiplier", type=float, default=1.5)
        if name == "disturb":
            job.add_argument("--keys", nargs="+", default=["API_Well_ID", "DateTime"])
            job.add_argument("--percent", type=float, default=5.0)
            job.add_argument("--noise-std", type=float, default=0.1)
            job.add_argument("--seed", type=int, default=42)
    chosen = parser.parse_args(words)
    if not chosen.input or not chosen.output:
        parser.error("name the folders by --input and --output or by INPUT_DIR and OUTPUT_DIR")
    return chosen


def run(spark, job: argparse.Namespace) -> None:
    source, target = job.input, job.output.rstrip("/")
    if job.job == "process":
        done = process_file(spark, source, ProcessingConfig(job.strategy, outlier_method=job.outlier_method))
        write_parquet(done.data, f"{target}/data", mode=job.mode)
        save_report(done.report, f"{target}/report", job.mode)
        done.history.write.mode(job.mode).json(f"{target}/history")
    elif job.job == "flag":
        _, skipped = folder_jobs.flag_folder(spark, source, f"{target}/data", f"{target}/summary", job.mode)
        skipped.write.mode(job.mode).json(f"{target}/skipped")
    elif job.job == "split-outliers":
        counts, skipped = folder_jobs.split_outliers_folder(
            spark, source, f"{target}/clean", f"{target}/outliers", job.columns, job.z_threshold, job.iqr_multiplier, job.mode)
        counts.write.mode(job.mode).json(f"{target}/counts")
        skipped.write.mode(job.mode).json(f"{target}/skipped")
    else:
        skipped = folder_jobs.disturb_folder(spark, source, target, job.keys, job.percent, noise_std=job.noise_std, seed=job.seed,
                                             mode=job.mode)
        skipped.write.mode(job.mode).json(f"{target}/_skipped")  # readers of the folder pass over it


if __name__ == "__main__":
    run(build_session("wellspring jobs"), arguments())
