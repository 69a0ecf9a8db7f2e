"""python -m basewise PROJECT GOAL... : makes goals of a project folder, or matches and filters reads."""

from __future__ import annotations

import argparse
from pathlib import Path

from .operators.report import tree_drawing
from .plans.config import read_properties, settings_table
from .plans.project import Project
from .session import VERSION, session
from .sources import sinks
from .sources.reads import map_file, resolved


def main(argv: list[str] | None = None) -> int:
    a = argparse.ArgumentParser(prog="basewise", description=__doc__)
    a.add_argument("project", help="folder with nodes.dmp, names.dmp, genomes (*.fasta, *.fna) and, if wanted, catalog.txt, taxids.txt, additional.txt, project.properties")
    a.add_argument("goals", nargs="*", default=["show"], help="show, showall, settings, match, matchlr, filter, extract, fasta2fastq, db2fastq, dbinfo, svgtaxtree, genall, or any goal that show lists")
    a.add_argument("-C", action="append", default=[], metavar="NAME=VALUE", help="a setting")
    a.add_argument("-f", action="append", default=[], metavar="READS", help="a FASTA or FASTQ file")
    a.add_argument("-k", default="", metavar="KEY", help="the key of the reads")
    a.add_argument("-m", metavar="MAPFILE", help="`key path` lines")
    a.add_argument("-d", "-r", metavar="FOLDER", help="where results go, by default the project's folder")
    a.add_argument("-t", default="make", choices=("make", "clean", "cleanall", "cleantotal"), help="make goals, delete what one made, with all that it needs, or everything")
    a.add_argument("-tx", metavar="TAXIDS", help="taxa for db2fastq, separated by commas; + after one adds its descendants")
    a.add_argument("-v", action="version", version=f"basewise {VERSION}")
    o = a.parse_intermixed_args(argv)
    home = Path(o.project)
    if o.goals == ["settings"]:
        print(settings_table())
        return 0
    there = lambda n: str(home / n) if (home / n).exists() else None
    own = read_properties((home / "project.properties").read_text()) if there("project.properties") else {}
    spark = session()
    genomes = sorted(str(p) for x in ("*.fasta", "*.fna", "*.fa", "*.fasta.gz", "*.fna.gz") for p in home.glob(x))
    p = Project(spark, home.name, o.d or str(home), str(home / "nodes.dmp"), str(home / "names.dmp"), genomes, there("catalog.txt"), there("taxids.txt"), there("additional.txt"), own | dict(x.split("=", 1) for x in o.C) | ({"taxids": o.tx} if o.tx else {}), there("categories.txt"))
    asked = [(o.k, f) for x in o.f for f in x.split(",")] + (map_file(Path(o.m).read_text()) if o.m else [])
    files = [(key, f) for key, path in asked for f in resolved(spark, path, [str(home / "fastq"), str(home), str(home.parent / "fastq")])]
    by_key = {key: [x for x in files if x[0] == key] for key, _ in files}
    if o.t == "cleantotal":
        o.goals = list(p.graph.goals)
    for goal in o.goals:
        if o.t != "make":
            if goal in ("match", "matchlr", "filter"):
                for key in by_key or {o.k: []}:
                    p.clean_results(goal, key)
            else:
                (p.graph.clean_all if o.t == "cleanall" else p.graph.clean)(goal)
        elif goal in ("show", "showall"):
            for g in p.graph.goals.values():
                if goal == "showall" or g.kept:
                    print(f"{g.name}: {g.about}" + (f" (needs {', '.join(g.needs)})" if goal == "showall" and g.needs else ""))
        elif goal in ("match", "matchlr"):
            for key, own in by_key.items():
                print(p.write_match(p.inputs(own), key, None if goal == "match" else False))
        elif goal == "filter":
            for key, own in by_key.items():
                kept, dumped = p.filter(p.inputs(own))
                sinks.write_fastq(kept, p.result("filter", key, ".fastq"), p.config["gzipFastqOutput"])
                if p.config["writeDumpedFastq"]:
                    sinks.write_fastq(dumped, p.result("filter_dumped", key, ".fastq"), p.config["gzipFastqOutput"])
        elif goal in ("extract", "fasta2fastq"):
            for key, own in by_key.items():
                rows = p.inputs(own)
                sinks.write_fastq(p.extract(rows) if goal == "extract" else rows, p.result(goal, key, ".fastq"), p.config["gzipFastqOutput"])
        elif goal == "db2fastq":
            sinks.write_fastq(p.table(goal), p.result(goal, o.tx or "total", ".fastq"), p.config["gzipFastqOutput"])
        elif goal == "dbinfo":
            sinks.write_csv(p.table(goal).orderBy("pos"), p.result(goal, "", ".csv"))
        elif goal == "genall":
            for name in ("dbinfo", "index"):
                p.table(name).write.format("noop").mode("overwrite").save()
        elif goal == "svgtaxtree":
            Path(p.folder, f"{p.name}_svgtaxtree.svg").write_text(tree_drawing(p.table("dbinfo")))
        else:
            p.table(goal).show(50, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
