"""Column expressions of the recorder: alleles, names, texts, rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Allele codes 1-4 stand for these bases, in this order.
BASES = ["A", "G", "C", "T"]


def hazard(probability: Column, interval) -> Column:
    """Constant hazard that gives the probability over the interval (F1)."""
    return -F.log1p(-probability) / interval


def probability(rate: Column, interval) -> Column:
    """Probability of an event within the interval at a constant hazard (F1)."""
    return -F.expm1(-rate * interval)


def base(code: Column) -> Column:
    """Base of an allele code, null outside 1..4."""
    number = code.cast("int")
    found = F.when(number == 1, F.lit(BASES[0]))
    for index, letter in enumerate(BASES[1:], start=2):
        found = found.when(number == index, F.lit(letter))
    return found


def inserted_code(allele: Column) -> Column:
    """Base code in the first decimal of an insertion allele; the remainder is floored."""
    return F.round(F.abs(F.pmod(allele, F.lit(1.0))) * 10).cast("int") % 10


def allele_kind(allele: Column) -> Column:
    """reference, deletion, substitution or insertion."""
    whole = F.pmod(allele, F.lit(1.0)) == 0
    return (F.when(allele == 0, "reference").when(allele == -1, "deletion")
            .when(whole & allele.between(1, 4), "substitution").otherwise("insertion"))


def alternate(allele: Column) -> Column:
    """Alternate text: a base, ``-`` or ``+base``."""
    kind = allele_kind(allele)
    return (F.when(kind == "deletion", "-").when(kind == "substitution", base(allele))
            .when(kind == "insertion", F.concat(F.lit("+"), base(inserted_code(allele)))))


def sequence_piece(allele: Column, reference: Column) -> Column:
    """Text a position contributes to a sequence.

    Digits of an insertion allele are read left to right: 0 is the reference
    base, or nothing under a minus sign, and 1-4 are inserted bases.
    """
    digits = F.split(F.regexp_replace(F.abs(allele).cast("string"), r"[^0-9]", ""), "")
    zero = F.when(allele > 0, reference).otherwise(F.lit(""))
    inserted = F.array_join(F.transform(F.filter(digits, lambda d: d != ""),
                                        lambda d: F.when(d == "0", zero).otherwise(F.coalesce(base(d), F.lit("")))), "")
    return (F.when(allele.isNull() | (allele == 0), reference).when(allele == -1, F.lit(""))
            .when(F.pmod(allele, F.lit(1.0)) == 0, base(allele)).otherwise(inserted))


def ones(text: Column) -> Column:
    """Number of ``1`` characters (F8)."""
    return F.length(text) - F.length(F.replace(text, F.lit("1"), F.lit("")))


def feature_name(unit: Column, position: Column) -> Column:
    """Matrix column name ``int_<unit>_pos_<position>``."""
    return F.concat(F.lit("int_"), unit.cast("string"), F.lit("_pos_"), position.cast("string"))


def feature_unit(name: Column) -> Column:
    return F.regexp_extract(name, r"^int_(\d+)_pos_(\d+)$", 1).cast("int")


def feature_position(name: Column) -> Column:
    return F.regexp_extract(name, r"^int_(\d+)_pos_(\d+)$", 2).cast("int")


def variant_name(position: Column, allele: Column) -> Column:
    """``mt_<position>_<allele>``; whole alleles print without decimals."""
    text = F.when(F.pmod(allele, F.lit(1.0)) == 0, allele.cast("bigint").cast("string")).otherwise(allele.cast("string"))
    return F.concat(F.lit("mt_"), position.cast("string"), F.lit("_"), text)


def newick_label(label: Column) -> Column:
    """Label quoted when it is empty or holds unsafe characters; quotes are doubled."""
    safe = label.rlike(r"^[A-Za-z0-9_.\-]+$")
    return F.when(safe, label).otherwise(F.concat(F.lit("'"), F.replace(label, F.lit("'"), F.lit("''")), F.lit("'")))


def dna(text: Column) -> Column:
    """Upper-case trimmed sequence of A, C, G, T, else null."""
    clean = F.upper(F.trim(text))
    return F.when(clean.rlike("^[ACGT]+$"), clean)


def base_codes(sequence: Column) -> Column:
    """Sequence to an array of codes 1-4."""
    return F.transform(F.split(F.translate(sequence, "".join(BASES), "1234"), ""), lambda c: c.cast("int"))


def codes_to_sequence(codes: Column) -> Column:
    return F.array_join(F.transform(codes, base), "")


def base_fraction(sequence: Column, letter: str) -> Column:
    """Share of one base in a sequence."""
    return F.try_divide(F.length(sequence) - F.length(F.replace(sequence, F.lit(letter), F.lit(""))), F.length(sequence))


def substitution_class(before: Column, after: Column) -> Column:
    """transition within purines or pyrimidines, else transversion."""
    pair = F.concat(before, after)
    return (F.when(before == after, F.lit(None).cast("string"))
            .when(pair.isin("AG", "GA", "CT", "TC"), "transition").otherwise("transversion"))


def condition_id(shape: Column, seed: Column, size: Column, units: Column) -> Column:
    """``<shape>_seed_<seed>_n_<cells>_k_<units>`` with zero-padded numbers."""
    return F.format_string("%s_seed_%03d_n_%06d_k_%03d", shape, seed, size, units)


def parse_condition_id(identifier: Column) -> dict[str, Column]:
    pattern = r"^(.*)_seed_(\d+)_n_(\d+)_k_(\d+)$"
    parts = {"shape": (1, "string"), "seed": (2, "int"), "cells": (3, "int"), "units": (4, "int")}
    return {n: F.regexp_extract(identifier, pattern, g).cast(t) for n, (g, t) in parts.items()}


def result_name_fields(name: Column) -> dict[str, Column]:
    """Fields of a result file name: tokens between underscores, each tag next to its value.

    ``ints`` follows its number, every other tag stands before its value.  After
    ``samp`` come ``type-rate`` tokens, one for each type, until another tag.
    """
    tokens = F.split(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), "_")

    def beside(tag: str, step: int) -> Column:
        at = F.array_position(tokens, tag)
        return F.when(at > 0, F.try_element_at(tokens, (at + step).cast("int")))

    def is_rate(token: Column) -> Column:
        return F.substring_index(token, "-", -1).try_cast("double").isNotNull() & token.contains("-")

    behind = F.filter(tokens, lambda x, i: i >= F.array_position(tokens, "samp"))
    stop = F.array_position(F.transform(behind, is_rate), False)
    rates = F.when(F.array_position(tokens, "samp") > 0, F.when(stop > 0, F.slice(behind, 1, (stop - 1).cast("int"))).otherwise(behind))
    shown = F.transform(F.coalesce(rates, F.array().cast("array<string>")), lambda x: F.concat(
        F.substr(x, F.lit(1), F.length(x) - F.length(F.substring_index(x, "-", -1)) - 1), F.lit(": "), F.substring_index(x, "-", -1)))
    return {
        "timept": beside("time", 1), "max_ints": beside("ints", -1).try_cast("int"),
        "int_recprob": beside("RP", 1).try_cast("double"), "condense_deletions": beside("CD", 1),
        "af_threshold": beside("AF", 1), "binarize": beside("B", 1),
        "cell_rec_fracs": F.array_join(shown, ", "),
    }


def delimited_numbers(text: Column, separator: str = ";") -> Column:
    """Delimited list to an array of numbers; text that is no number gives null."""
    return F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("double"))


def seed_for(base_seed: int, *parts: int) -> int:
    """Seed of a sub-run: modular mix that stays within the range of a 32-bit seed."""
    value = base_seed
    for part in parts:
        value = (value * 1_000_003 + part) % 2_147_483_647
    return value


def whole_numbers(text: str) -> list[int]:
    """Grid argument ``1,2,5`` as sorted distinct positive numbers."""
    try:
        values = sorted({int(x) for x in text.split(",")})
    except ValueError as error:
        raise ValueError(f"not a list of whole numbers: {text}") from error
    if not values or values[0] < 1:
        raise ValueError("grid values must be positive")
    return values
