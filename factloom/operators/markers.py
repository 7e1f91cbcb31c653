"""Relation markers, both ways.

A text of relations names each head once after ``<triplet>``, then its tails and
types: ``<triplet> head <subj> tail <obj> type <subj> tail <obj> type``.  The
typed form puts the entity types' markers in place of ``<subj>`` and ``<obj>``:
head type before the tail, tail type before the relation.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit
TRIPLET, SUBJ, OBJ = "<triplet>", "<subj>", "<obj>"


def _joined(relations: Column, tail_part) -> Column:
    """A relation repeats its head only where the relation before has another;
    each looks at its neighbour, so the text is built in one pass."""
    def part(r: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(relations, i - 1)["head"] == r["head"])
        start = F.when(i > 0, " ").otherwise("")
        return F.when(same, F.concat(L(" "), tail_part(r, False))).otherwise(
            F.concat(start, L(TRIPLET + " "), r["head"], L(" "), tail_part(r, True)))
    return F.array_join(F.transform(relations, part), "")


def linearise(relations: Column) -> Column:
    """Array of (head, tail, type) to text."""
    return _joined(relations, lambda r, new: F.concat(L(SUBJ + " "), r["tail"], L(f" {OBJ} "), r["type"]))


def linearise_typed(relations: Column, markers: Mapping[str, str]) -> Column:
    """Array of (head, head_type, tail, tail_type, type) to text; ``markers``
    names each entity type's marker."""
    of = F.create_map(*[L(x) for pair in markers.items() for x in pair])

    def tail_part(r: Column, new: bool) -> Column:
        gap = "  " if new else " "  # two spaces after the first marker of a head
        return F.concat(F.element_at(of, r["head_type"]), L(gap), r["tail"], L(" "),
                        F.element_at(of, r["tail_type"]), L(" "), r["type"])
    return _joined(relations, tail_part)


#: Stand-ins of the markers while a text is taken apart; all are white space to
#: ``_coded``, so no word holds them.
_HEAD, _OPEN, _CLOSE = "\x1c", "\x1d", "\x1e"
_WHITE = r"[\s\x1c-\x1f]+"


def _coded(text: Column, marks: Mapping[str, str]) -> Column:
    """The words of a text with a single space between, markers as ``marks`` has them."""
    plain = F.regexp_replace(text, "<s>|<pad>|</s>", "")
    of = F.create_map(*[L(x) for pair in marks.items() for x in pair])
    return F.array_join(F.transform(F.split(plain, _WHITE), lambda w: F.coalesce(F.element_at(of, w), w)), " ")


def _parts(text: Column, mark: str) -> Column:
    return F.transform(F.split(text, mark), lambda p: F.trim(p))


def _let(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), L(0))


def extract(text: Column) -> Column:
    """Text to array of (head, tail, type).

    The text is cut at ``<triplet>`` into blocks and a block at ``<subj>`` into
    parts; a part ends a relation if it has a type.  Words before the first marker
    belong to nothing.  The head is the block's own.  A part opened by no
    ``<subj>`` keeps the last tail: part g of block i has g - i of them before its
    end.  A part without ``<obj>`` keeps the type of the part before it in its
    block.  The text's last relation must have a head and a tail as well."""
    def block(b: Column, i: Column) -> Column:
        cut = F.transform(_parts(b, _OPEN), lambda p: _parts(p, _CLOSE))
        types = F.transform(cut, lambda p, j: F.when(F.size(p) > 1, F.element_at(p, -1)).when(j == 0, ""))

        def part(p: Column, j: Column) -> Column:
            kept = F.element_at(F.array_compact(F.slice(types, 1, j + 1)), -1)
            return F.struct(F.when(i > 0, F.get(F.get(cut, L(0)), L(0))).otherwise("").alias("head"),
                            F.coalesce(F.get(types, j), kept).alias("type"), i.alias("block"))
        return F.transform(cut, part)

    def relations(coded: Column) -> Column:
        # a tail reaches up to the marker behind it
        tails = F.transform(F.split(coded, _OPEN), lambda t, s: F.when(
            s > 0, F.trim(F.get(F.split(t, f"[{_HEAD}{_CLOSE}]"), L(0)))).otherwise(""))
        parts = F.flatten(F.transform(_parts(coded, _HEAD), block))

        def named(tail: Column) -> Column:
            return F.transform(parts, lambda p, g: F.struct(
                p["head"].alias("head"), F.get(tail, g - p["block"]).alias("tail"), p["type"].alias("type")))
        return _let(_let(tails, named), lambda all_: F.filter(all_, lambda r, g: (r["type"] != "") & (
            (g + 1 < F.size(all_)) | ((r["head"] != "") & (r["tail"] != "")))))

    return _let(_coded(text, {TRIPLET: _HEAD, SUBJ: _OPEN, OBJ: _CLOSE}), relations)


def extract_typed(text: Column, markers: Mapping[str, str]) -> Column:
    """Typed text to array of (head, head_type, tail, tail_type, type).

    Inside a block (cut at ``<triplet>``) the entity markers come in turn: one that
    names the head's type and opens a tail, one that names the tail's type and opens
    the relation's.  So relation q of a block lies in its segments 2q - 1 and 2q; a
    last tail without a type keeps the type before it.  The part before the first
    ``<triplet>`` has neither head nor first tail: two empty segments stand for them.
    The text's last relation must have a head and a tail as well."""
    rows = "array<struct<head:string,head_type:string,tail:string,tail_type:string,type:string>>"
    names = {mark: _OPEN + name + _CLOSE for name, mark in markers.items()}

    def segment(p: Column) -> Column:
        named = F.split(p, _CLOSE)
        return F.struct(F.get(named, L(0)).alias("kind"), F.trim(F.element_at(named, -1)).alias("words"))

    def block(b: Column, i: Column) -> Column:
        empty = F.struct(L("").alias("kind"), L("").alias("words"))
        cut = F.transform(F.split(b, _OPEN), segment)
        whole = F.when(i > 0, cut).otherwise(F.concat(F.array(empty, empty), F.slice(cut, L(2), F.size(cut))))

        def relations(segs: Column) -> Column:
            last = F.size(segs) - 1

            def relation(q: Column) -> Column:
                tail = F.get(segs, 2 * q - 1)
                # the type of this tail, or of the one before where the block ends with a tail
                kind = F.get(segs, F.when(2 * q <= last, 2 * q).otherwise(2 * q - 2))
                return F.struct(F.get(segs, L(0))["words"].alias("head"), tail["kind"].alias("head_type"),
                                tail["words"].alias("tail"), kind["kind"].alias("tail_type"), kind["words"].alias("type"))
            # a lone tail is no relation
            told = F.when(last >= 2, F.transform(F.sequence(L(1), F.floor((last + 1) / 2).cast("int")), relation))
            return F.coalesce(told, F.array().cast(rows))
        return F.transform(_let(whole, relations), lambda r: F.struct(i.alias("block"), r.alias("r")))

    def all_of(blocks: Column) -> Column:
        told = F.flatten(F.transform(blocks, block))

        def told_whole(xs: Column) -> Column:
            def counts(x: Column, g: Column) -> Column:
                last = (x["block"] + 1 == F.size(blocks)) & (g + 1 == F.size(xs))
                others = F.array(*[x["r"][c] for c in ("head", "head_type", "tail", "tail_type")])
                return (x["r"]["type"] != "") & (~last | F.forall(others, lambda v: v != ""))
            return F.transform(F.filter(xs, counts), lambda x: x["r"])
        return _let(told, told_whole)

    return _let(F.split(_coded(text, {TRIPLET: _HEAD} | names), _HEAD), all_of)
