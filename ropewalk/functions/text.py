"""Text expressions. Everything here is a native Column expression (no Python in the tasks)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Identifier alphabet and id lengths of stored graphs.
_NOT_ID = "[^a-z0-9]+"
_ID_WORD = "[a-z0-9]+"
SKILL_ID_LENGTH = 64
STEP_ID_LENGTH = 48
# Runs of non-space characters; (?U) makes \s follow Unicode, the range adds the four separators.
_NOT_SPACE = r"(?U)[^\s\x1c-\x1f]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _identifier(text: Column | str, length: int, default: str) -> Column:
    joined = F.btrim(F.regexp_replace(F.lower(_col(text)), _NOT_ID, "_"), F.lit("_"))
    cut = F.substring(joined, 1, length)
    return F.when(F.length(cut) > 0, cut).otherwise(F.lit(default))


def slugify(text: Column | str) -> Column:
    """Stable skill id: lower case, runs of other characters become one underscore, 64 chars."""
    return _identifier(text, SKILL_ID_LENGTH, "node")


def canon_id(text: Column | str) -> Column:
    """Stable step id, 48 chars."""
    return _identifier(text, STEP_ID_LENGTH, "step")


def tokens(text: Column | str) -> Column:
    """ASCII word tokens of the lower-cased text (used by the hash embedding)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(_ID_WORD), F.lit(0))


def ws_tokens(text: Column | str) -> Column:
    """Whitespace tokens of the lower-cased text, Unicode whitespace included (used by BM25)."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(_NOT_SPACE), F.lit(0))


def est_tokens(text: Column | str) -> Column:
    """Token estimate: four characters per token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(_col(text)) / 4).cast("long"))


def loaded_tokens(token_cost: Column | str, body: Column | str) -> Column:
    """Measured cost when there is one, else the estimate from the body."""
    cost = _col(token_cost).cast("long")
    return F.when(F.coalesce(cost, F.lit(0)) != 0, cost).otherwise(est_tokens(body))


def strip(text: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(_col(text), r"(?U)^\s+|\s+\z", "")


def _text(col: Column | str) -> Column:
    return F.coalesce(_col(col), F.lit(""))


def vector_text(name: Column | str, description: Column | str, body: Column | str) -> Column:
    return F.concat(_text(name), F.lit(". "), _text(description), F.lit(" "), _text(body))


def bm25_text(name: Column | str, description: Column | str, body: Column | str) -> Column:
    return F.concat(_text(name), F.lit(" "), _text(description), F.lit(" "), _text(body))


def section_name(target: Column | str, after: Column | str, file: Column | str) -> Column:
    """Name of the record an edit addresses: first non-empty field, heading marks removed."""
    first = F.coalesce(
        *[F.when(F.length(_col(c)) > 0, _col(c)) for c in (target, after, file)],
        F.lit("general"),
    )
    bare = strip(F.regexp_replace(strip(first), r"^#+", ""))
    return F.when(F.length(bare) > 0, bare).otherwise(F.lit("general"))


def paragraphs(body: Column | str) -> Column:
    """Blank-line separated parts, trimmed, empty ones removed."""
    parts = F.transform(F.split(_col(body), "\n\n"),
                        lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", ""))
    return F.filter(parts, lambda p: F.length(p) > 0)


def trace_cut(text: Column | str, n: int = 12000) -> Column:
    return F.substring(_col(text), 1, n)
