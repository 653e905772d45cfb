"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skysieve.checks.all_queries import QUERIES  # noqa: E402
from skysieve.session import build_session  # noqa: E402

HEADLINE = [
    "a19_beam_power_scan", "j1_beamform_frames", "j2_correlate", "j3_apply_gains", "a27_iterative_gains", "c1_channeliser",
    "w10_channeliser_blocks", "w1_rolling_noise", "p3_subtract_noise", "p8_triangle_fallback", "j7_pepper_filter",
    "e2_filter_chain", "c6_adaptive_threshold", "c8_space_partition", "c10_dbscan", "c11_streak_detector", "c14_hough_segments",
    "w4_best_snr", "a13_track_summary", "c17_batch_association", "k5_tdm_lines", "j12_illumination", "j4_latest_calibration",
    "j6_schedule_conflicts", "s9_packet_sequence", "x3_stream_rolling_noise", "s1_raw_voltage_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else None)
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    # one small query starts the JVM and the Python workers before anything is timed
    QUERIES["a3_antenna_rms"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["j1_beamform_frames"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name:32s} {times[name]:8.2f}", file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf.group(1)) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
