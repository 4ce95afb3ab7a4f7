"""Motif files in the common text formats. They are a few kilobytes, so they are parsed on the driver, through Spark's text
reader, so that any file system will do; the motifs then go into plans as tables or with functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..operators.motifs import Motif, normalise, table

_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def _numbers(line: str) -> list[float]:
    return [float(x) for x in _NUMBER.findall(line)]


def _row(line: str, skip: int = 0) -> list[float] | None:
    """Four numbers behind ``skip`` fields of a line."""
    fields = line.split()[skip : skip + 4]
    try:
        return [float(x) for x in fields] if len(fields) == 4 else None
    except ValueError:
        return None


def _made(name: str, rows, score: float | None = None, **extra) -> Motif:
    weights = normalise(np.array(rows, dtype=float))
    m = Motif(name, weights, extra=extra)
    if score is None:  # the mean of 2 less the entropy in nats, as files without a score are ranked
        score = float((2 + (weights * np.log(weights)).sum(axis=1)).mean())
    m.score = score
    return m


def transfac(text: str) -> Iterator[Motif]:
    """Blocks of ``DE name consensus score ...``, a header of bases, numbered rows, ``XX``."""
    name, score, rows = "", None, []
    for line in [*text.splitlines(), "XX"]:
        fields = line.split()
        if not fields:
            continue
        if fields[0] in ("DE", "NA", "ID"):
            if fields[0] == "DE" or not name:
                name = fields[1] if len(fields) > 1 else ""
            numbers = [f for f in fields[3:4] if _NUMBER.fullmatch(f)]
            score = float(numbers[0]) if fields[0] == "DE" and numbers else score
        elif fields[0].isdigit() and (row := _row(line, 1)):
            rows.append(row)
        elif fields[0] in ("XX", "//") and rows:
            yield _made(name, rows, score)
            name, score, rows = "", None, []


def jaspar(text: str) -> Iterator[Motif]:
    """``>name`` and four rows, one for each base, with or without the base and brackets."""
    for block in re.split(r"(?m)^>", text)[1:]:
        head, *rest = block.splitlines()
        rows = [_numbers(re.sub(r"^\s*[ACGT]\b", "", r)) for r in rest if _NUMBER.search(r)][:4]
        if len(rows) == 4 and len({len(r) for r in rows}) == 1 and rows[0]:
            yield _made(head.split()[0] if head.split() else "", np.array(rows).T)


def meme(text: str) -> Iterator[Motif]:
    for block in re.split(r"(?m)^MOTIF\s+", text)[1:]:
        name = block.split()[0]
        found = re.search(r"letter-probability matrix:([^\n]*)\n((?:\s*[-+0-9.eE]+(?:[ \t]+[-+0-9.eE]+){3}[ \t]*\n?)+)", block)
        if found:
            sites = re.search(r"nsites=\s*([0-9.]+)", found[1])
            m = _made(name, [_row(r) for r in found[2].splitlines() if r.strip()])
            m.sites = float(sites[1]) if sites else 0.0
            yield m


def chipmunk(text: str) -> Iterator[Motif]:
    """``KDIC|score`` before rows ``A|n n n``."""
    for i, block in enumerate(re.split(r"(?m)^KDIC\|", text)[1:]):
        rows = [_numbers(m[2]) for m in re.finditer(r"(?m)^([ACGT])\|(.*)$", block)][:4]
        if len(rows) == 4:
            yield _made(f"motif{i + 1}", np.array(rows).T, float((_numbers(block.split("\n")[0]) or [0.0])[0]))


def four_rows(text: str, label: bool = False) -> Iterator[Motif]:
    """Four rows of numbers for each motif, one for each base; with a label before each row if ``label``."""
    rows = [(line.split()[0], _numbers(" ".join(line.split()[1:]))) if label else (None, _numbers(line)) for line in text.splitlines() if _NUMBER.search(line)]
    for i in range(0, len(rows) - 3, 4):
        part = [r for _, r in rows[i : i + 4]]
        if len({len(r) for r in part}) == 1 and part[0]:
            yield _made(rows[i][0] or f"motif{i // 4 + 1}", np.array(part).T)


def uniprobe(text: str, compat: bool = False) -> Iterator[Motif]:
    """A header line, then ``A: n n n`` and so on. compat: each motif gets the next header's name, as older programs read."""
    found, head = [], ""
    rows: list[list[float]] = []
    for line in text.splitlines():
        if m := re.match(r"\s*([ACGT])\s*:\s*(.*)", line):
            rows.append(_numbers(m[2]))
            if len(rows) == 4:
                found.append((head, rows))
                rows = []
        elif line.strip():
            head = line.strip()
    heads = [h for h, _ in found]
    names = [*heads[1:], *heads[-1:]] if compat else heads
    for name, (_, r) in zip(names, found, strict=True):
        fields = name.split("\t")
        score = float(fields[7]) if len(fields) > 7 and _NUMBER.fullmatch(fields[7].strip()) else None
        yield _made(fields[0].split()[0], np.array(r).T, score)


def headed_rows(text: str, head: str = ">", least: int = 1, skip: int = 0) -> Iterator[Motif]:
    """A line that starts with ``head``, then a row of four numbers for each column; at least ``least`` columns."""
    name, rows = "", []
    for line in [*text.splitlines(), head]:
        if line.startswith(head):
            if len(rows) >= least:
                yield _made(name, rows)
            name, rows = (line[len(head) :].split() or [""])[0], []
        elif row := _row(line, skip):
            rows.append(row)


def cisfinder(text: str) -> Iterator[Motif]:
    return headed_rows(text, ">", 1, 1)


def weeder(text: str) -> Iterator[Motif]:
    """Rows of four numbers behind a column number under each ``All Occurrences`` header; 5 columns or more."""
    for i, block in enumerate(re.split(r"All Occurrences", text)[1:]):
        rows = [r for line in block.splitlines() if line.split() and line.split()[0].isdigit() and (r := _row(line, 1))]
        if len(rows) >= 5:
            yield _made(f"motif{i + 1}", rows)


def trawler(text: str) -> Iterator[Motif]:
    return headed_rows(text, ">", 5)


def amadeus(text: str) -> Iterator[Motif]:
    """``PwmMotif(...):`` lines, each followed by a row of column heads, a rule and four rows of numbers between bars, one for
    each base. Files without such a line: ``Motif name`` headers with rows of four numbers behind a column number."""
    rows = text.splitlines()
    heads = [i for i, line in enumerate(rows) if "PwmMotif(" in line]
    if not heads:
        yield from headed_rows(text, "Motif", 1, 1)
    for i in heads:
        width = rows[i + 1].count("|") - 1 if i + 1 < len(rows) else 0
        cells = [line.split("|")[1 : width + 1] for line in rows[i + 3 : i + 7]]
        if width < 1 or len(cells) < 4 or any(len(c) < width for c in cells):
            raise ValueError(f"the motif of line {i + 1} isn't whole")
        yield _made(rows[i].split(":")[0], np.array([[float(c) for c in row] for row in cells]).T)


def comma_transfac(text: str) -> Iterator[Motif]:
    return transfac(text.replace(",", " "))


def gapped(text: str) -> Iterator[Motif]:
    """TRANSFAC blocks followed by ``XXD`` groups ``i-j:kmer|p<tab>...`` up to ``XXX``: joint probabilities of columns."""
    for block in re.split(r"(?m)^XXX\s*$", text):
        first, _, groups = block.partition("\nXXD")
        for m in transfac(first.replace("\nXX\n", "\n") + "\nXX"):
            m.extra["groups"] = {}
            for line in groups.splitlines():
                if ":" in line:
                    columns, _, values = line.partition(":")
                    m.extra["groups"][tuple(int(c) for c in columns.split("-"))] = {k: float(p) for k, _, p in (v.partition("|") for v in values.split("\t") if "|" in v)}
            yield m


#: Endings of file names (those with a dot), or parts of them, and their readers. The order decides names that fit several: up
#: to jaspar it is that of older programs. Files with other endings are read by naming a layout.
FORMATS: list[tuple[str, Callable[[str], Iterator[Motif]]]] = [
    (".dat", transfac),
    (".zifnet", lambda t: four_rows(t, True)),
    (".traw", trawler),
    (".dpwm", gapped),
    (".pwm", transfac),
    (".meme", meme),
    ("meme.txt", meme),
    (".wee", weeder),
    (".cisf", cisfinder),
    ("cisfinder", cisfinder),
    ("thetafinal", four_rows),
    (".unip", uniprobe),
    ("chipmunk", chipmunk),
    ("jaspar", jaspar),
    (".transfac", comma_transfac),
    (".trans", comma_transfac),
    (".admout", amadeus),
    ("zifnet", lambda t: four_rows(t, True)),
    ("uniprobe", uniprobe),
    ("weeder", weeder),
    ("wee", weeder),
    ("trawler", trawler),
    ("amadeus", amadeus),
]


def read(spark: SparkSession, path: str, limit: int | None = None, layout: str | None = None) -> list[Motif]:
    """The motifs of a file, by its name; the best ``limit`` ones by score, if given.

    layout: the name by which the reader is chosen instead, for files with another ending: ".pwm", "jaspar" and so on.
    """
    name = layout or path.rsplit("/", 1)[-1].lower()
    parser = next((p for key, p in FORMATS if (name.endswith(key) if key.startswith(".") else key in name)), None) or next((p for key, p in FORMATS if key in name), None)
    if parser is None:
        raise ValueError(f"no motif format is known by the name {name}")
    text = spark.read.text(path, wholetext=True).first()
    found = list(parser(text[0] if text else ""))
    return found if limit is None else sorted(found, key=lambda m: (-m.score, m.name))[:limit]


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, read(spark, path))


def read_background(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, p) of lines ``kmer p``; lines that start with # are comments."""
    from pyspark.sql import functions as F

    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(r"^\s*[ACGT]+\s+[-+0-9.eE]+\s*$")).select(parts[0].alias("prefix"), parts[1].cast("double").alias("p"))
