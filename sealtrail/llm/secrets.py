"""Secret scans: patterns plus sliding-window entropy of candidate strings, all native.

The pattern part finds assignments of credentials, access keys and long hexadecimal runs.
The entropy part looks at every run of base64-like characters: a window slides over the
run, the counts of its characters change by one in and one out, and so does the sum
``sum(c * log2 c)`` behind the Shannon entropy ``log2(w) - sum / w``.  Harmless parts (words
of a path, dates, rulers) are cut out of a run first.  If the best window of what is left, or
of a part of it between slashes, reaches the threshold of its character class, the run is a
secret, unless the allow list knows all of that or a pattern has found it already.

Everything happens inside one row with built-in expressions: no shuffle, no Python.  Work
is linear in the text and in its number of matches (match positions are summed in chunks).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"

KINDS = ("assign", "access", "hex", "entropy")

_CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
_CHUNK = 256


_UUID = r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}"
#: A word of one case or of humps, maybe with a number behind it, or a number.  Repeated groups are
#: possessive throughout: others take a stack frame per repetition, and texts may repeat them 10^5 times.
#: What a repetition takes is bounded by what must follow it, so nothing has to be given back.
_WORD = r"(?:(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*+|[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)(?![A-Za-z0-9])"
_NAME = rf"(?=[^/]{{3}})(?:{_WORD}(?:[-_]{_WORD})*+|{_UUID})"


@dataclass(frozen=True)
class EntropyRule:
    """Windows of ``width`` characters; thresholds in bits by class of what is scored.

    ``hex`` holds for hexadecimal digits only, ``alnum`` for letters and digits, ``base64`` for
    the rest.  What is scored needs a letter and a digit.  ``cut`` are regular expressions of
    harmless parts, taken out before scoring; ``allow`` are those of harmless strings, anchored
    at both ends, since random ones may hold anything.
    """

    width: int = 20
    hex: float = 3.0
    alnum: float = 3.75
    base64: float = 3.75
    allow: tuple[str, ...] = (
        rf"^{_UUID}$",
        r"^[A-Za-z]+[0-9]{1,4}$",  # a word with a number behind it
        r"(?i)^sha(1-[a-z0-9+/]{27}=|256-[a-z0-9+/]{43}=|512-[a-z0-9+/]{86}==)$",  # integrity attributes are public
    )
    cut: tuple[str, ...] = (
        r"(?:^|(?<=/))[0-9]+(?:-[0-9]+(?=[-_/]|$)){2,}+(?:[-_]|(?=/|$))",  # dates and phone numbers
        rf"/{_NAME}(?=/|$)|^{_NAME}(?=/)",  # names in addresses and paths
        r"(.)\1{7,}",  # rulers and padding
    )


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m>>: the matches of ``pattern``, leftmost and not overlapping."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")
    return F.when(F.size(matches) > 0, _positions(F.split(text, pattern, -1), matches)).otherwise(none)


def _positions(pieces: Column, matches: Column) -> Column:
    """Positions from the texts between the matches; the running sum goes chunk by chunk."""
    pairs = F.transform(
        F.arrays_zip(pieces.alias("p"), matches.alias("m")),
        lambda z: F.struct(F.length(z["p"]).alias("gap"), F.length(z["m"]).alias("len"), z["m"].alias("m")),
    )
    pairs = F.filter(pairs, lambda z: z["m"].isNotNull())
    empty = F.expr(
        "named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,m:string>>))"
    )

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["gap"]
        end = start + z["len"]
        one = F.struct(start.alias("start"), end.alias("end"), z["m"].alias("m"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        # the small array grows one by one, the large one by whole chunks
        begun = F.struct(acc["at"].alias("at"), F.filter(acc["out"], lambda _: F.lit(False)).alias("out"))
        done = F.aggregate(part, begun, step)
        return F.struct(done["at"].alias("at"), F.concat(acc["out"], done["out"]).alias("out"))

    # the pairs are bound as a lambda variable, so that they are computed once
    return F.transform(
        F.array(pairs),
        lambda all_: F.aggregate(
            F.transform(
                F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / _CHUNK).cast("int")),
                lambda i: F.slice(all_, i * _CHUNK + 1, _CHUNK),
            ),
            empty,
            chunk,
            lambda acc: acc["out"],
        ),
    )[0]


def _assigned(m: Column) -> Column:
    return F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8


def _plogp(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def best_entropy(token: Column, width: int) -> Column:
    """Largest Shannon entropy (bits) of a window of ``width`` characters of ``token``.

    Shorter tokens have none (0).  Counts live in an array beside the distinct characters
    and change by the character that enters and the one that leaves.
    """
    chars = F.split(token, "", -1)

    def over(chars: Column) -> Column:
        codes = F.transform(
            F.array(F.array_distinct(chars)),
            lambda distinct: F.transform(chars, lambda c: F.array_position(distinct, c).cast("int")),
        )[0]

        def walk(codes: Column) -> Column:
            zero = F.struct(
                F.array_repeat(F.lit(0), F.array_max(codes)).alias("n"), F.lit(0.0).alias("s"), F.lit(0.0).alias("best")
            )

            def step(acc: Column, i: Column) -> Column:
                came = F.element_at(codes, i)
                went = F.when(i > width, F.element_at(codes, F.greatest(i - width, F.lit(1)))).otherwise(F.lit(0))
                more = F.element_at(acc["n"], came)
                left = F.element_at(acc["n"], F.greatest(went, F.lit(1)))
                out = F.when(went > 0, _plogp(left - 1) - _plogp(left)).otherwise(F.lit(0.0))
                changed = F.when(went == came, F.lit(0.0)).otherwise(_plogp(more + 1) - _plogp(more) + out)
                counts = F.transform(
                    acc["n"],
                    lambda c, k: c + F.when(k + 1 == came, 1).otherwise(0) - F.when(k + 1 == went, 1).otherwise(0),
                )
                s = acc["s"] + changed
                h = F.when(i >= width, F.log2(F.lit(float(width))) - s / width).otherwise(F.lit(0.0))
                return F.struct(counts.alias("n"), s.alias("s"), F.greatest(acc["best"], h).alias("best"))

            return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda acc: acc["best"])

        return F.transform(F.array(codes), walk)[0]

    return F.transform(F.array(chars), over)[0]


def _entropic(m: Column, rule: EntropyRule) -> Column:
    """Whether what is harmless in a candidate leaves something as random as a secret."""

    def random(piece: Column) -> Column:
        needed = (
            F.when(piece.rlike("^[0-9a-fA-F]+$"), rule.hex)
            .when(piece.rlike("^[0-9A-Za-z]+$"), rule.alnum)
            .otherwise(rule.base64)
        )
        known = F.lit(False)
        for pattern in rule.allow:
            known = known | piece.rlike(pattern)
        shaped = (F.length(piece) >= rule.width) & piece.rlike("[0-9]") & piece.rlike("[A-Za-z]") & ~known
        return F.when(shaped, best_entropy(piece, rule.width) >= needed).otherwise(F.lit(False))

    known = F.lit(False)
    for pattern in rule.allow:
        known = known | m.rlike(pattern)
    left = m
    for pattern in rule.cut:
        left = F.regexp_replace(left, pattern, "")
    pieces = F.transform(
        F.array(left),
        lambda x: F.array_distinct(F.concat(F.array(x), F.split(x, "/", -1), F.array(F.regexp_replace(x, "^/+|/+$", "")))),
    )[0]
    return F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~known, F.exists(pieces, random)).otherwise(F.lit(False))


def _kept(found: Column, kind: int, keep) -> Column:
    return F.transform(
        F.filter(found, lambda x: keep(x["m"])),
        lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")),
    )


def secret_spans(docs: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule(), prefix: str = "secret_") -> DataFrame:
    """``docs`` with three arrays of ``struct<start, kind, end>``, ordered, ends exclusive.

    ``<prefix>base`` holds the pattern matches, ``<prefix>added`` what only entropy shows
    (never overlapping a base span), ``<prefix>spans`` both.  ``kind`` is the index in
    ``KINDS``; positions are code points.  A null text counts as empty.  Every input column
    stays; columns of these names are replaced.  Rows are independent: repeated rows give
    repeated results, and an empty table an empty one.
    """
    whole = F.coalesce(docs[text], F.lit(""))
    base, added, spans, step = (f"{prefix}{x}" for x in ("base", "added", "spans", "runs"))
    found = docs.withColumns({
        base: F.array_sort(F.concat(
            _kept(_located(whole, ASSIGN), 0, _assigned),
            _kept(F.when(whole.contains("AKIA"), _located(whole, ACCESS)).otherwise(_none()), 1, lambda _: F.lit(True)),
            _kept(_located(whole, HEX), 2, lambda _: F.lit(True)),
        )),
        step: F.filter(_located(whole, _CANDIDATE % rule.width), lambda x: _entropic(x["m"], rule)),
    })
    found = found.withColumn(added, F.filter(
        _kept(found[step], 3, lambda _: F.lit(True)),
        lambda x: ~F.exists(found[base], lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])),
    ))
    return found.withColumn(spans, F.array_sort(F.concat(found[base], found[added]))).drop(step)


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,m:string>>)")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )))


def _redacted(text: Column, pattern: str, secret, mark: str) -> Column:
    """``text`` with the matches that are secret replaced; rebuilt from its pieces in one go."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rebuilt = F.concat_ws("", F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("p"), matches.alias("m")),
        lambda z: F.concat(z["p"], F.when(z["m"].isNull(), "").when(secret(z["m"]), mark).otherwise(z["m"])),
    ))
    return F.when(F.size(matches) > 0, rebuilt).otherwise(text)


def redact_secrets(docs: DataFrame, text: str = "text", rule: EntropyRule = EntropyRule(), mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``.

    Kinds are replaced one after the other in the order of ``KINDS``, each on the text that
    the one before left.  Rows, other columns and null texts stay as they are.
    """
    always = lambda _: F.lit(True)
    out = docs
    for pattern, secret in (
        (ASSIGN, _assigned), (ACCESS, always), (HEX, always), (_CANDIDATE % rule.width, lambda m: _entropic(m, rule)),
    ):
        out = out.withColumn(text, _redacted(F.col(f"`{text}`"), pattern, secret, mark))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = secret_spans(docs)
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("secret_base")), 256).alias("base_sha256"),
        spans_text(F.col("secret_spans")).alias("spans"),
        F.size("secret_added").cast("long").alias("n_entropy"),
    )
