"""Column functions on references, labels and short texts."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of references.
LOCAL = r"^(?:oq|[bcqmtk])\d+$"
CONTAINER = r"^[A-Z][A-Za-z]*\d{4}"


def _plain_letters() -> tuple[str, str]:
    """Letters with accents, and the letter or digit of ASCII that each decomposes to."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xA0, 0x2100)]
    kept = [(c, "".join(d for d in parts if not unicodedata.combining(d))) for c, parts in pairs]
    kept = [(c, p) for c, p in kept if len(p) == 1 and p != c and p.isascii()]
    return "".join(c for c, _ in kept), "".join(p for _, p in kept)


ACCENTED, PLAIN = _plain_letters()


def fold_ascii(c: Column) -> Column:
    """Letters without their accents."""
    return F.translate(F.regexp_replace(c, r"\p{M}", ""), ACCENTED, PLAIN)


def ref_form(ref: Column) -> Column:
    """local, sharpened, container or broad."""
    sharpened = F.contains(ref, F.lit(":"))
    return F.when(sharpened, "sharpened").when(F.startswith(ref, F.lit("@")), "container").when(ref.rlike(LOCAL), "local").when(ref.rlike(CONTAINER), "container").otherwise("broad")


def global_id(ck: Column, ref: Column) -> Column:
    """A local reference with its container's key before it; others as they are."""
    return F.when(ref_form(ref) == "local", F.concat_ws(":", ck, ref)).otherwise(ref)


def ref_key(ref: Column) -> Column:
    return F.split(ref, ":", 2)[0]


def ref_tid(ref: Column) -> Column:
    return F.when(F.contains(ref, F.lit(":")), F.split(ref, ":", 2)[1])


def kind_by_prefix(ref: Column) -> Column:
    """What a reference's local id says it is: test, capability, method, question or claim; null for other forms."""
    tail = F.when(ref_form(ref).isin("local", "sharpened"), F.coalesce(ref_tid(ref), ref))
    return F.when(tail.rlike(r"^t\d+$"), "test").when(tail.rlike(r"^k\d+$"), "capability").when(tail.rlike(r"^m\d+$"), "method").when(tail.rlike(r"^o?q\d+$"), "question").when(tail.rlike(r"^[bc]\d+$"), "claim")


def slice_label(kind: Column, floor: Column, borrowed: Column, grounded: Column) -> Column:
    """question, floor, model, borrowed, grounded or plausible; borrowed goes before grounded."""
    return F.when(kind == "question", "question").when(floor, "floor").when(kind == "method", "model").when(borrowed, "borrowed").when(grounded, "grounded").otherwise("plausible")


def aim_label(kind: Column, at_risk: Column, aspirational: Column, floor: Column, modality: Column) -> Column:
    """A programme's label: a claim's modality, what is amiss with a test or capability, whether a method is a floor."""
    plain = F.when(kind == "claim", F.coalesce(modality, F.lit("speculation"))).when(kind == "method", F.when(floor, "floor").otherwise("model"))
    return plain.when((kind == "test") & at_risk, "test-at-risk").when((kind == "capability") & aspirational, "capability-aspirational").otherwise(kind)


def work_type(raw: Column) -> Column:
    return F.when(F.lower(F.trim(raw)).isin("review", "review-article"), "review").otherwise("original")


def local_refs(refs: Column) -> Column:
    return F.filter(refs, lambda r: ref_form(r) == "local")


def is_programme(ref: Column) -> Column:
    return F.coalesce(F.startswith(ref, F.lit("@")), F.lit(False))


def valid_rects(rects: Column) -> Column:
    """A list of one or more rectangles of four numbers from 0 to 1."""
    return F.coalesce((F.size(rects) > 0) & F.forall(rects, lambda r: (F.size(r) == 4) & F.forall(r, lambda v: v.between(0, 1))), F.lit(False))


def short_text(text: Column, most: int) -> Column:
    """White space as single spaces, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)
