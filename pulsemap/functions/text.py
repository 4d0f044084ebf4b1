"""Text columns: case folding, tokens, segments, personal data, vectors. Spark expressions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexicon import ENGLISH, Language


def tr_lower(text: Column) -> Column:
    return F.lower(F.translate(text, "Iİ", "ıi"))


def fold(text: Column) -> Column:
    """Turkish lower case without its accents."""
    return F.translate(tr_lower(text), "çğıöşüâîû", "cgiosuaiu")


def tokens(text: Column, lang: Language = ENGLISH) -> Column:
    """Letter runs, normalised for the language."""
    normal = fold(text) if lang.code == "tr" else F.lower(text)
    return F.regexp_extract_all(normal, F.lit(r"(?U)([^\W\d_]+)"), F.lit(1))


def strip(text: Column, characters: str) -> Column:
    some = "[" + "".join(re.escape(c) for c in characters) + "]+"
    return F.regexp_replace(text, f"^{some}|{some}$", "")


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is used: it lies in an array of one."""
    return F.element_at(F.transform(F.array(value), use), 1)


def segments(text: Column, product_names: tuple[str, ...] = (), lang: Language = ENGLISH) -> Column:
    """array<string> of what the text says: quotes only where it quotes, without greetings, tags and openers."""
    text = F.coalesce(text, F.lit(""))
    quotes = F.regexp_extract_all(text, F.lit("[\"“]([^\"”]{15,})[\"”]"), F.lit(1))
    said = bound(quotes, lambda qs: F.when(F.size(qs) > 0, F.array_join(F.transform(qs, lambda q: strip(q, " \t\n\r\f\v")), " ")).otherwise(text))
    for name in product_names:
        said = F.regexp_replace(said, rf"(?iU)\b\Q{name}\E(?:['’][^\W\d_]+)?\b", "")
    raw = F.transform(F.split(said, r"(?<=[.!?])\s+|\n+"), lambda s: strip(s, " ,;\t"))

    def cleaned(s: Column) -> Column:
        for _ in range(3):
            s = F.regexp_replace(s, lang.leading, "")
        s = strip(F.regexp_replace(s, r"\s{2,}", " "), " ,;-–—")
        return bound(s, lambda c: F.when(F.substring(c, 2, 1).rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2)))).otherwise(c))

    kept = F.filter(raw, lambda s: ~s.rlike(lang.salutation))
    out = F.transform(kept, cleaned)
    return F.when(F.trim(text) == "", F.expr("cast(array() as array<string>)")).otherwise(F.filter(out, lambda s: (F.length(s) >= 3) & s.rlike(r"(?U)[^\W\d_]")))


def segment_feedback(feedback: DataFrame, product_names: tuple[str, ...] = (), lang: Language = ENGLISH, sentences: bool = True) -> DataFrame:
    """(doc_id, position, text); a document without segments keeps its text, or ``(empty)``."""
    whole = F.array(F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "(empty)").otherwise(F.trim("text")))
    found = segments(F.col("text"), product_names, lang) if sentences else F.expr("cast(array() as array<string>)")
    cut = feedback.select("doc_id", "text", found.alias("_found"))
    return cut.select("doc_id", F.posexplode(F.when(F.size("_found") == 0, whole).otherwise(F.col("_found"))).alias("position", "text"))


def replaced_if(text: Column, pattern: str, valid, by: str) -> Column:
    """text with the pattern's matches that are valid replaced; the others stay. Texts without a match are passed by."""

    def replaced(t: Column) -> Column:
        new = F.concat(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: F.when(valid(m), F.lit(by)).otherwise(m)), F.array(F.lit("")))
        return F.when(t.rlike(pattern), F.array_join(F.zip_with(F.split(t, pattern, -1), new, lambda a, b: F.concat(a, b)), "")).otherwise(t)

    return bound(text, replaced)


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn_valid(m: Column) -> Column:
    return F.length(digits_of(m)).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits_of(m)), F.lit(False))


def tckn_valid(m: Column) -> Column:
    """Checksum of the 11-digit Turkish national number."""
    d = [F.substring(m, k + 1, 1).cast("int") for k in range(11)]
    tenth = F.pmod((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
    return m.rlike("^[1-9][0-9]{10}$") & (tenth == d[9]) & (F.pmod(sum(d[1:10], d[0]), F.lit(10)) == d[10])


def redact(text: Column) -> Column:
    """The passes' patterns and their order. E-mail, IBAN, card, national number, phones."""
    swapped = lambda t, gate, pattern, by: bound(t, lambda x: F.when(gate(x), F.regexp_replace(x, pattern, by)).otherwise(x))
    t = swapped(text, lambda x: F.contains(x, F.lit("@")), r"(?U)\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b", "[email]")
    t = F.regexp_replace(t, r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b", "[iban]")
    t = replaced_if(t, r"(?<![0-9])(?:[0-9][ -]?){12,18}[0-9](?![0-9])", luhn_valid, "[card]")
    t = replaced_if(t, r"(?<![0-9])[1-9][0-9]{10}(?![0-9])", tckn_valid, "[national-id]")
    t = swapped(t, lambda x: x.rlike("5[0-9]{2}"), r"(?<![0-9])(?:\+?90[ -]?)?\(?0?5[0-9]{2}\)?[ -]?[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}(?![0-9])", "[phone]")
    return swapped(t, lambda x: F.contains(x, F.lit("+")), r"(?U)(?<!\w)\+[0-9]{1,3}[ -]?(?:[0-9][ -]?){6,12}[0-9](?![0-9])", "[phone]")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector at unit length. The norm lies in an array of one, so that it is computed once and not for each component."""
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))
    return F.element_at(F.transform(F.array(norm), lambda n: F.transform(v, lambda x: x / n)), 1)
