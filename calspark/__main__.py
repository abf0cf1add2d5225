"""Command line: python -m calspark --input FOLDER [--recording FILE] --out FOLDER [--settings FILE], or --frames PATH --height H --width W."""

from __future__ import annotations

import argparse

from calspark import settings as S


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="calspark", description="Run the stage chain over a table of frames.")
    parser.add_argument("--input", nargs="+", help="folders with the files of a recording")
    parser.add_argument("--recording", help="JSON file that says what was recorded")
    parser.add_argument("--frames", help="Parquet table plane, frame, arr")
    parser.add_argument("--height", type=int)
    parser.add_argument("--width", type=int)
    parser.add_argument("--out", help="folder for the tables of the run")
    parser.add_argument("--plane", type=int, help="only this plane")
    parser.add_argument("--settings", help="JSON file laid over the defaults")
    parser.add_argument("--print-settings", action="store_true", help="print all settings and stop")
    given = parser.parse_args(args)
    if given.print_settings:
        print(S.markdown(S.Recording()), S.markdown(), sep="\n\n")
        return 0
    if not given.out or not (given.input or given.recording or given.frames and given.height and given.width):
        parser.error("--out and either --input, --recording or --frames with --height and --width are needed")
    from pyspark.sql import SparkSession

    from calspark.pipeline import run
    from calspark.session import log_to, ship
    from calspark.sources.recording import convert

    spark = SparkSession.builder.appName("calspark").getOrCreate()
    ship(spark)
    log = log_to(given.out if "://" not in given.out else None)
    height, width, frames2 = given.height, given.width, None
    if given.input or given.recording:
        record = S.overlay(S.Recording(), S.load(given.recording)) if given.recording else S.Recording()
        record = S.overlay(record, {"data_path": given.input}) if given.input else record
        found = convert(spark, record, f"{given.out}/recording")
        if len(set(found.shapes.values())) != 1:
            parser.error(f"planes differ in size: {found.shapes}; run them one by one from {given.out}/recording")
        (height, width), frames = next(iter(found.shapes.values())), found.frames.select("plane", "frame", "arr")
        frames2 = found.frames2 and found.frames2.select("plane", "frame", "arr")
        log.info("%d planes of %d x %d pixels", len(found.shapes), height, width)
    else:
        frames = spark.read.parquet(given.frames)
    if given.plane is not None:
        frames = frames.where(f"plane = {given.plane}")
        frames2 = frames2 and frames2.where(f"plane = {given.plane}")
    made = S.overlay(S.user_settings(), S.load(given.settings)) if given.settings else S.user_settings()
    for name, table in run(frames, height, width, given.out, made, frames2=frames2).items():
        log.info("table %s", name)
        if name not in ("registered", "offsets", "references"):
            table.write.mode("overwrite").parquet(f"{given.out}/result/{name}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
