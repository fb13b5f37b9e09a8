"""Scalar column functions for prices, categories, clock times, names and paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plural category to singular.
SINGULAR = {
    "bezerros": "bezerro",
    "bezerras": "bezerra",
    "garrotes": "garrote",
    "novilhos": "novilho",
    "novilhas": "novilha",
    "bois": "boi",
    "touros": "touro",
    "vacas": "vaca",
    "machos": "macho",
    "fêmeas": "fêmea",
    "mistos": "misto",
}

_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any Unicode kind at the ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def number(c: Column | str) -> Column:
    """Decimal text to double; null for anything else (also for inf and nan)."""
    s = strip(c)
    return F.when(s.rlike(_NUMBER), F.replace(s, F.lit("_"), F.lit("")).try_cast("double"))


def price_text(c: Column | str) -> Column:
    """'R$ 3.100,00' to 3100.0: points group thousands, a comma is the decimal sign."""
    s = F.replace(F.replace(F.replace(col(c), F.lit("R$"), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return number(s)


def price_text_blank(c: Column | str) -> Column:
    """Whether a price text says nothing (null or no characters beside signs), which is a null price and no error."""
    return F.coalesce(strip(F.regexp_replace(col(c), r"R\$|\.", "")) == "", F.lit(True))


def repair_small(c: Column | str) -> Column:
    """A number between 0 and 100 lost its thousands separator: times 1000."""
    c = col(c)
    return F.when((c > 0) & (c < 100), c * 1000).otherwise(c)


def singular_category(c: Column | str) -> Column:
    """Trimmed, lower-case, known plurals as singulars; unknown ones stay."""
    s = F.lower(strip(c))
    known = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in SINGULAR.items()))
    return F.coalesce(F.try_element_at(known, s), s)


def hms(seconds: Column | str) -> Column:
    """Whole seconds to HH:MM:SS; hours may take more digits."""
    s = col(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60)))


def _part(parts: Column, i: int, kind: str = "bigint") -> Column:
    return F.get(parts, F.lit(i)).try_cast(kind)


def hms_seconds(c: Column | str) -> Column:
    """H:M:S to seconds from the first three parts; null if one is no number."""
    p = F.split(col(c), ":")
    return _part(p, 0) * 3600 + _part(p, 1) * 60 + _part(p, 2)


def hms_seconds_strict(c: Column | str) -> Column:
    """Seconds of exactly three parts, else null."""
    return F.when(F.size(F.split(col(c), ":")) == 3, hms_seconds(c))


def progress_seconds(c: Column | str) -> Column:
    """HH:MM:SS.ffffff to double seconds; anything else is 0."""
    p = F.split(col(c), ":")
    return F.coalesce(F.when(F.size(p) == 3, _part(p, 0) * 3600 + _part(p, 1) * 60 + _part(p, 2, "double")), F.lit(0.0))


def comma_seconds(c: Column | str) -> Column:
    """HH:MM:SS,mmm to double seconds."""
    p = F.split(col(c), "[:,]")
    return _part(p, 0) * 3600 + _part(p, 1) * 60 + _part(p, 2) + _part(p, 3) / 1000.0


def money(c: Column | str) -> Column:
    """R$ with thousands commas and two decimals."""
    return F.concat(F.lit("R$ "), F.format_number(col(c), 2))


def dash(c: Column | str) -> Column:
    """Text, or - for null and empty."""
    return F.coalesce(F.nullif(col(c).cast("string"), F.lit("")), F.lit("-"))


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null where there is none."""
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, group))


# Patterns of names in free notes.
_QUOTED = r"(?iu)(?:canal do YouTube|anunciado como)\s+'([^']+)'"
_NUMBERED = r"(?iuU)\b(Leilão\s+\d+º)"
_HOUSE = r"(?iuU)\bCAL\s+LEIL[ÕO]ES\b"
_CALLER = r"(?U)[Oo]?\s*[Ll]eiloeiro(?:\s+mencionado(?:\s+no\s+áudio)?)?\s*(?:é|:)\s*([^\.]+)"


def auction_name(auctioneer: Column | str, farm: Column | str, notes: Column | str) -> Column:
    """Farm, an auctioneer that names an auction, a name in the notes, else the auctioneer."""
    a, notes = col(auctioneer), col(notes)
    return F.coalesce(
        F.nullif(col(farm), F.lit("")),
        F.when(F.lower(a).contains("leil"), a),
        _found(notes, _QUOTED),
        _found(notes, _NUMBERED),
        F.when(F.regexp_like(notes, F.lit(_HOUSE)), F.lit("CAL LEILÕES")),
        a,
    )


def auctioneer_name(auctioneer: Column | str, notes: Column | str) -> Column:
    """The auctioneer that the notes mention, else the given one."""
    return F.coalesce(strip(_found(col(notes), _CALLER)), col(auctioneer))


def first_text(*cs: Column | str) -> Column:
    """The first that is neither null nor empty, else the last."""
    return F.coalesce(*(F.nullif(col(c), F.lit("")) for c in cs[:-1]), col(cs[-1]))


def is_clock(c: Column | str) -> Column:
    """A broadcast clock HH:MM:SS and nothing else."""
    return col(c).rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$")


def evidenced_lots(text: Column | str) -> Column:
    """Numbers (no leading zeros) that the text gives as a lot's: one pass for all lots of a window."""
    patterns = (
        r"(?iU)\bLOTE\s*[:#-]?\s*([0-9]+)\b",
        r"(?iU)\bLOTE\s*\|\s*[^|\n]*\|\s*VALORPORANIMAL\s*\|\s*([0-9]+)\b",
        r"(?U)\|\s*([0-9]+)\s*(?=\|)",
    )
    found = F.concat(*(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(p), F.lit(1)) for p in patterns))
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(n, "^0+(?=[0-9])", "")))


def has_evidence(lot_number: Column | str, evidenced: Column | str) -> Column:
    return F.array_contains(col(evidenced), col(lot_number).cast("string"))


def clip(c: Column | str, n: int) -> Column:
    """The first n characters; null is empty."""
    return F.left(F.coalesce(col(c), F.lit("")), F.lit(n))


def token_cost(tokens_in: Column | str, tokens_out: Column | str, price_in: Column | str, price_out: Column | str) -> Column:
    """Cost at prices per million tokens."""
    return col(tokens_in) / 1e6 * col(price_in) + col(tokens_out) / 1e6 * col(price_out)


def elapsed(seconds: Column | str) -> Column:
    """minutes and seconds of a duration."""
    s = F.floor(col(seconds))
    return F.struct(F.floor(s / 60).alias("minutes"), F.pmod(s, F.lit(60)).alias("seconds"))


def video_id(url: Column | str) -> Column:
    """Id in a watch URL's query or a short link's path; null where a provider has to be asked."""
    u = col(url)
    host = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    path = F.regexp_extract(u, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)
    v = F.regexp_extract(query, r"(?:^|&)v=([^&]+)", 1)
    return F.when(host.contains("youtube.com") & (v != ""), F.try_url_decode(v)).when(host.contains("youtu.be"), F.regexp_replace(path, "^/+", ""))


def last_v_id(url: Column | str) -> Column:
    """Text behind the last 'v=' up to an ampersand."""
    return F.split_part(F.element_at(F.split(col(url), "v="), -1), F.lit("&"), F.lit(1))


def safe_folder(name: Column | str, fallback: str = "batch") -> Column:
    """Letters, digits and ._- stay, the rest becomes -; none of .- at the ends."""
    s = F.regexp_replace(col(name), r"[^\p{L}\p{N}._-]", "-")
    return F.coalesce(F.nullif(F.regexp_replace(s, r"^[.-]+|[.-]+$", ""), F.lit("")), F.lit(fallback))


def model_folder(name: Column | str) -> Column:
    return F.translate(col(name), "/:", "__")


def truthy_price(c: Column | str) -> Column:
    """Neither null nor zero."""
    return F.coalesce(col(c) != 0, F.lit(False))
