"""Where the modules of this package register their queries."""

from __future__ import annotations

from collections.abc import Callable

from ..sources import corpus

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL that gives the same rows, where SQL can."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def over_seqs(body: str, *more: str) -> str:
    """SQL with the sequences as seqs, and more common tables."""
    return f"WITH {', '.join([corpus.SQL, *more])} {body}"


def recursive(sql: str) -> str:
    """SQL whose common tables may refer to themselves."""
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return RC.format(x)


def windows(k: int, table: str = "seqs") -> str:
    """A common table kmers<k> of (seq_id, pos, kmer)."""
    return f"kmers{k} AS (SELECT seq_id, pos, substr(seq, pos + 1, {k}) AS kmer, weight FROM (SELECT seq_id, seq, weight, unnest(range(0, length(seq) - {k - 1})) AS pos FROM {table}))"
