"""From an image tree to leakage-free index files."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from kelpwork.operators import allocate, components, fingerprint, images, lsh, report
from kelpwork.plans.shared import Stage, write_text
from kelpwork.sources.config import Settings
from kelpwork.sources.images import scan_dataset, with_content
from kelpwork.sources.sinks import cache_key, cached, write_index, write_metadata


def cluster(rows: DataFrame, hash_size: int = 16, threshold: int = 6, num_bands: int | None = None, workers: int | None = None, root: str = "") -> DataFrame:
    """Scan rows with ``fp`` (null: unreadable) and ``cluster_id`` (null with it)."""
    stage = Stage(rows.sparkSession, "cluster")
    decode = images.decode_gray
    prints = fingerprint.image_fingerprint(with_content(rows.select("row_idx", "path"), root=root), "row_idx", decode, hash_size=hash_size, num_partitions=workers)
    prints = stage.write(prints, "prints")
    reps = lsh.representatives(prints)
    ids = components.cluster_ids(prints, reps, lsh.near_edges(reps, threshold, num_bands, hash_size * hash_size))
    return rows.join(prints, "row_idx").join(ids, "row_idx", "left")


def run(spark: SparkSession, config: dict, config_path: str = "", force: bool = False, keep_going: bool = False) -> bool:
    """The whole pipeline; returns whether no cluster spans two splits. Index files of a leaking split are written only
    with ``keep_going``."""
    config = Settings(config)
    data, dedup, split = config["dataset"], config["dedup"], config["split"]
    classes, ratios, seed = data.get("classes"), split["ratios"], split.get("seed", 0)
    allocate.check_ratios(ratios)
    scanned, info = scan_dataset(spark, data["train_root"], classes)
    if scanned.isEmpty():
        raise SystemExit(f"no images below {data['train_root']}")
    settings = {"hash_size": dedup.get("hash_size", 16), "threshold": dedup.get("hamming_threshold", 6), "num_bands": dedup.get("num_bands")}
    key = cache_key(scanned, settings | {"version": 2})
    make = lambda: cluster(scanned, workers=dedup.get("num_workers"), root=data["train_root"], **settings)
    clustered, hit = cached(spark, config.target(dedup.get("cache", "clusters")), key, make, force)
    kept = clustered.where("fp IS NOT NULL").drop("fp")
    assignment = allocate.allocate(allocate.cluster_summary(kept), ratios, seed, split.get("stratify_by_class", True))
    rows = Stage(spark, "pipeline").write(allocate.with_split(kept, assignment), "rows")
    leaks = allocate.leaking_clusters(rows).count()
    if leaks == 0 or keep_going:
        write_index(rows, config.target(split.get("index_dir", "splits")), list(ratios))
    counts = fingerprint.n_dropped(clustered).first().asDict()
    stats = report.cluster_stats(rows).first().asDict()
    meta = {
        "created_utc": datetime.now(timezone.utc).isoformat(), "config_path": config_path, "train_root": data["train_root"], "seed": seed,
        "num_classes": data.get("num_classes"), "images_scanned": counts["scanned"], "images_dropped": counts["dropped"], "images_kept": counts["kept"],
        "num_clusters": stats["n_clusters"], "ratios": dict(ratios), "leakage_ok": leaks == 0, "cache_hit": hit,
    }
    write_metadata(spark, config.target(f"{split.get('index_dir', 'splits')}.meta.json"), meta)
    bands = len(lsh.band_layout(settings["hash_size"] ** 2, settings["threshold"], settings["num_bands"]))
    warnings = [f"missing class folders {info['missing_classes']}"] * bool(info["missing_classes"]) + [f"extra folders {info['extra_folders']}"] * bool(info["extra_folders"])
    text = report.text_report(
        "Split report", {"root": data["train_root"], "scanned": counts["scanned"], "dropped": counts["dropped"], "kept": counts["kept"], "bands": bands}, stats,
        report.split_totals(rows).collect(), report.label_split_pivot(rows).orderBy("label").collect(), warnings, leaks,
    )
    write_text(spark, config.target(config.get("report", {}).get("path", "report.txt")), text + "\n")
    print(text)
    return leaks == 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--force", action="store_true", help="make the cluster table anew")
    parser.add_argument("--keep-going", action="store_true", help="write index files even if a cluster spans two splits")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("kelpwork").getOrCreate()
    return 0 if run(spark, Settings.from_yaml(args.config), args.config, args.force, args.keep_going) else 1


if __name__ == "__main__":
    sys.exit(main())
