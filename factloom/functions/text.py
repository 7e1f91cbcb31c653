"""String scalars (P1–P7, P13) and text/array helpers (T1–T7), as built-in
column expressions (JVM-side, no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.vocab import RESOURCE_NS, RESOURCE_NS_HTTPS

L = F.lit


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row: a lambda over one element.
    A column expression that is named twice is evaluated twice."""
    return F.get(F.transform(F.array(value), use), L(0))


def where_any(x: Column, marks, use) -> Column:
    """``use(x)`` where ``x`` holds one of ``marks``, ``x`` itself elsewhere: a search costs a
    fraction of a replacement.  ``x`` is named several times, so it is a field or a ``let``."""
    held = F.contains(x, L(marks[0]))
    for m in marks[1:]:
        held = held | F.contains(x, L(m))
    return F.when(held, use(x)).otherwise(x)


def canonical_iri(name: Column) -> Column:
    """Strip the resource namespace, percent-encode (keeping / _ - ~ and
    letters/digits), then encode '.' as %2E."""
    bare = F.replace(F.replace(name, L(RESOURCE_NS), L("")), L(RESOURCE_NS_HTTPS), L(""))
    enc = F.url_encode(bare)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), (".", "%2E")):
        enc = F.replace(enc, L(a), L(b))
    return enc


def local_name(iri: Column) -> Column:
    """Text after the last '#', else after the last '/'."""
    return F.when(F.contains(iri, L("#")), F.substring_index(iri, "#", -1)) \
        .otherwise(F.substring_index(iri, "/", -1))


def clean_txt(x: Column) -> Column:
    """Trim all surrounding whitespace; empty → null."""
    v = F.regexp_replace(x, r"^\s+|\s+$", "")
    return F.when(v != "", v)


def strip_prefixes(x: Column, prefixes) -> Column:
    """P5: trim, then remove every ``prefix:``."""
    v = F.regexp_replace(x, r"^\s+|\s+$", "")
    for p in prefixes:
        v = F.replace(v, L(p + ":"), L(""))
    return v


# P7 spacing-repair rule sets (fixed values, applied in this order).
REPAIR_COMMON = [
    ('=" ', '="'), (" : ", ":"), (" :", ":"), (": ", ":"), (" #", "#"), ("< ", "<"), ("</ ", "</"),
    ("= ", "="), ("<? ", "<?"), ("# ", "#"), (" >", ">"), (" <", "<"), (" =", "="), ("/ ", "/"),
    ("/ ", "/"), (' "/>', '"/>'), (' ">', '">'), (' ":"', '":"'), (":<", ": <"), (" ^", "^"),
    ("^ ", "^"), ("><", "> <"),
]
REPAIR_SET3_HEAD = [("<s>", ""), ("</s>", ""), (":", " :"), ('=" ', '="'), (": ", ":"), (" #", "#"),
                    ("< ", "<"), ("</ ", "</"), ("= ", "="), ("<? ", "<?"), ("# ", "#"), (" >", ">"),
                    (" <", "<"), (" =", "="), ("/ ", "/"), ("/ ", "/"), (' "/>', '"/>'), (' ">', '">'),
                    (' ":"', '":"'), (":<", ": <"), (" ^", "^"), ("^ ", "^"), ("><", "> <")]


def _apply(x: Column, rules) -> Column:
    for a, b in rules:
        x = F.replace(x, L(a), L(b))
    return x


def repair_spacing(x: Column, rule_set: int) -> Column:
    """Rule set 1 keeps <s> (Q21), set 2 strips <s>/</s> and trims, set 3
    also first spaces colons then re-joins them, then trims."""
    if rule_set == 1:
        return _apply(x, REPAIR_COMMON)
    if rule_set == 2:
        return clean_txt(_apply(x, [("<s>", ""), ("</s>", "")] + REPAIR_COMMON))
    return clean_txt(_apply(x, REPAIR_SET3_HEAD))


def label_is_special(label: Column) -> Column:
    """P13 predicate: contains '(' or '.' or ','."""
    return F.contains(label, L("(")) | F.contains(label, L(".")) | F.contains(label, L(","))


def simplify_label(label: Column) -> Column:
    """Cut at '('; if the result has ',', cut the *original* label at ','
    (each cut restarts from the original); drop tokens containing '.'."""
    t = F.when(F.contains(label, L("(")), F.substring_index(label, "(", 1)).otherwise(label)
    t = F.when(F.contains(t, L(",")), F.substring_index(label, ",", 1)).otherwise(t)
    toks = F.filter(F.split(t, r"\s+"), lambda w: (w != "") & ~F.contains(w, L(".")))
    t = F.when(F.contains(t, L(".")), F.array_join(toks, " ")).otherwise(t)
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def sentences(paragraph: Column) -> Column:
    """Split after '.' followed by whitespace (the dot stays)."""
    return F.split(paragraph, r"(?<=\.)\s+")


def paragraphs(text: Column) -> Column:
    """Split on newlines, skip empty paragraphs."""
    return F.filter(F.split(text, "\n"), lambda p: F.length(F.trim(p)) > 0)


def space_punct(text: Column) -> Column:
    """Spaces around [ ] . , ! ? ( ), drop ( ), collapse whitespace."""
    t = F.regexp_replace(text, r"([\[\].,!?()])", " $1 ")
    t = F.regexp_replace(t, r"[()]", "")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


TOKEN_RE = r"\w+|[^\w\s]"


def regex_token_count(text: Column) -> Column:
    """X1 default tokenizer: word runs and single punctuation marks."""
    return F.size(F.regexp_extract_all(text, L(TOKEN_RE), 0))


def truncate_to_budget(df, text_col: str, budget: int, overhead: Column | int = 0, out: str = "truncated",
                       count_tokens=regex_token_count):
    """T3 as a DataFrame step: text unchanged when it fits; else the longest
    prefix of its '.'-parts (empty parts dropped, re-joined with '.') whose
    token count plus overhead fits, and never all of its parts.  Tokens are
    additive over parts (+1 per joining dot), so one pass over the parts, which
    counts those that fit, decides the cut.  ``overhead`` may depend on the row
    and ``count_tokens`` is the tokenizer (X1)."""
    text = F.col(text_col)
    overhead = overhead if isinstance(overhead, Column) else L(overhead)
    df = df.withColumns({"_parts": F.filter(F.split(text, r"\."), lambda p: p != ""),
                         "_ntok": count_tokens(text), "_over": overhead})
    df = df.withColumn("_toks", F.transform("_parts", count_tokens))
    # used: tokens so far with the dots between parts; keep: parts that fit.
    fits = F.aggregate(
        "_toks", F.struct(L(-1).alias("used"), L(0).alias("keep")),
        lambda acc, t: F.struct((acc["used"] + t + 1).alias("used"),
                                (acc["keep"] + F.when(acc["used"] + t + 1 + F.col("_over") <= budget, 1).otherwise(0))
                                .alias("keep")))["keep"]
    df = df.withColumn("_keep", F.greatest(F.least(fits, F.size("_parts") - 1), L(0)))
    cut = F.array_join(F.slice("_parts", 1, F.col("_keep")), ".")
    return df.withColumn(out, F.when(F.col("_ntok") + F.col("_over") <= budget, text).otherwise(cut)) \
        .drop("_parts", "_ntok", "_toks", "_keep", "_over")


def token_ids(text: Column) -> Column:
    """Token array for T4–T6/A11: whitespace tokens mapped to small ints
    (3 + (31·length + first code point) mod 997; 0 = pad, 2 = start)."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.transform(words, lambda w: ((F.length(w) * 31 + F.ascii(w)) % 997 + 3).cast("int"))


def truncate_pad(ids: Column, max_len: int, pad: int = 0) -> Column:
    """T4: cut to max_len, right-pad with ``pad``."""
    cut = F.slice(ids, 1, max_len)
    return F.concat(cut, F.array_repeat(L(pad), L(max_len) - F.size(cut)))


def mask_pad(ids: Column, pad: int = 0) -> Column:
    """T5: pad → -100."""
    return F.transform(ids, lambda x: F.when(x == pad, L(-100)).otherwise(x))


def shift_right(ids: Column, start: int = 2, pad: int = 0) -> Column:
    """Prepend the start id, drop the last, unmask -100 to pad."""
    shifted = F.concat(F.array(L(start)), F.slice(ids, 1, F.size(ids) - 1))
    return F.transform(shifted, lambda x: F.when(x == -100, L(pad)).otherwise(x))


def shift_left(ids: Column, pad: int = 0) -> Column:
    """Drop the first, append the pad; no ids stay none."""
    return F.when(F.size(ids) > 0, F.concat(F.slice(ids, L(2), F.size(ids) - 1), F.array(L(pad)))).otherwise(ids)


def flat_words(sentences: Column) -> Column:
    """The words of all sentences, joined by a space."""
    return F.array_join(F.flatten(sentences), " ")
