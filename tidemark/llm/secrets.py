"""Secret scans: known patterns, and the entropy of sliding windows over candidate strings. DataFrame functions only.

Candidates are runs of one character class. A window of fixed width moves over each; the counts of its characters are
kept up to date by the one that enters and the one that leaves, and with them the sum of c * log2(c), from which the
entropy follows. Windows over the class's limit form a span, unless the candidate is on the allow list.
Places are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents

# The base patterns, their group and the least length of that group.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
# Name, alphabet, pattern of the alphabet, window width, bits of entropy a window has at least.
CLASSES = (
    ("hex_entropy", "0123456789abcdefABCDEF", "[0-9a-fA-F]", 20, 3.0),
    ("base64_entropy", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", "[A-Za-z0-9+/_-]", 24, 3.9),
)
#: Every match but those of assign is a run of 20 of these at least; texts without one need no further look.
GATE = "[A-Za-z0-9+/_-]{20}"
#: Candidates that match one of these are no secrets: words of one case or capitalised, numbers, identifiers of words, paths, placeholders.
ALLOWED = (r"^[A-Z]?[a-z]+$|^[A-Z]+$", r"^[0-9]+$", r"^([A-Z]?[a-z]+|[A-Z]+)([_/-]([A-Z]?[a-z]+|[A-Z]+))*[_/-]?$", r"(?i)example|placeholder|changeme|dummy|x{6}|0{12}")


def _long(pattern: str, least: int) -> str:
    """The pattern of maximal runs, of `least` characters at least."""
    return f"{pattern[:-1]}{{{least},}}"


def _spans(text: Column, gate: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """array<struct<at, kind, until>> of the leftmost matches that do not overlap, and whose group has `least` characters."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), F.length)
    each = F.arrays_zip(between.alias("gap"), F.transform(matches, F.length).alias("long"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,kind:int,until:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        end = begin + F.coalesce(x["long"], F.lit(0))
        hit = F.coalesce(F.length(x["value"]) >= least, F.lit(False))
        one = F.array(F.struct(begin.alias("at"), F.lit(kind).alias("kind"), end.alias("until")))
        return F.struct(end.alias("at"), F.when(hit, F.concat(s["found"], one)).otherwise(s["found"]).alias("found"))

    none = F.array().cast("array<struct<at:int,kind:int,until:int>>")
    return F.when(gate & text.rlike(pattern), F.aggregate(each, start, step)["found"]).otherwise(none)


def _base(text: Column, words: Column, runs: Column) -> list[Column]:
    out = []
    for kind, (_, pattern, group, least) in enumerate(BASE):
        # a maximal run that is too short hides no other match, so only long ones need be found; access has its 4 letters first
        short = {"access": _long(pattern, least - 4), "hex": _long(pattern, least)}.get(BASE[kind][0], pattern)
        out.append(_spans(text, words if kind == 0 else runs, short, kind, group, least))
    return out


def _window(candidate: Column, alphabet: str, width: int, bits: float) -> Column:
    """struct<first, last>: where the first window over the limit starts and the last one ends within the candidate; nulls if none is."""
    logs = F.array(*[F.lit(n * math.log2(n) if n else 0.0) for n in range(width + 2)])
    state = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    place = lambda i: F.instr(F.lit(alphabet), F.substring(candidate, i, F.lit(1)))

    def moved(s: Column, at: Column, by: int) -> Column:
        """The state after one more (by = 1) or one less (by = -1) of the character in place `at` of the alphabet; 0: none."""
        n = F.coalesce(F.get(s["counts"], at - 1), F.lit(0))
        change = F.when(at > 0, F.get(logs, n + by) - F.get(logs, n)).otherwise(0.0)
        counts = F.transform(s["counts"], lambda c, k: c + F.when(k == at - 1, by).otherwise(0))
        return F.struct(counts.alias("counts"), (s["sum"] + change).alias("sum"), s["first"].alias("first"), s["last"].alias("last"))

    def step(s: Column, i: Column) -> Column:
        return F.struct(
            s["counts"].alias("counts"), s["sum"].alias("sum"),
            F.when((i >= width) & (math.log2(width) - s["sum"] / width >= bits), F.coalesce(s["first"], i - width)).otherwise(s["first"]).alias("first"),
            F.when((i >= width) & (math.log2(width) - s["sum"] / width >= bits), i).otherwise(s["last"]).alias("last"),
        )

    whole = F.sequence(F.lit(1), F.length(candidate))
    leave = lambda i: F.when(i > width, place(i - width)).otherwise(0)
    # each step enters, leaves and judges; they are chained over one-element arrays so that every state is computed once
    then = lambda s, f: F.get(F.transform(F.array(s), f), F.lit(0))
    end = F.aggregate(whole, state, lambda s, i: then(then(moved(s, place(i), 1), lambda t: moved(t, leave(i), -1)), lambda t: step(t, i)))
    return F.struct(end["first"].alias("first"), end["last"].alias("last"))


def _entropy(text: Column, gate: Column, kind: int) -> Column:
    name, alphabet, pattern, width, bits = CLASSES[kind - len(BASE)]
    runs = _spans(text, gate, f"{pattern}{{{width},}}", kind, 0, width)

    def judged(r: Column) -> Column:
        candidate = F.substring(text, r["at"] + 1, r["until"] - r["at"])
        allowed = F.lit(False)
        for p in ALLOWED:
            allowed = allowed | candidate.rlike(p)
        w = F.when(~allowed, _window(candidate, alphabet, width, bits))
        return F.get(F.transform(F.array(w), lambda x: F.struct((r["at"] + x["first"]).alias("at"), r["kind"].alias("kind"), (r["at"] + x["last"]).alias("until"))), F.lit(0))

    return F.filter(F.transform(runs, judged), lambda x: x["at"].isNotNull())


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x[0]) for x in (*BASE, *CLASSES)])
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["at"].cast("string"), x["until"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256, spans (a string) and secret_spans (array<struct<at, kind, until>>, sorted).

    Null and empty texts have no spans; the hash is then that of an empty string. Rows stay as they are, repeated ones too; an empty
    table gives no rows. Texts are read as a whole, however long. Columns of docs with the names above are replaced; redacted()
    keeps rows apart from them.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lower = F.lower(whole)
    gated = docs.withColumns({"_secret_words": lower.contains("passw") | lower.contains("secret") | lower.contains("token") | lower.contains("api"), "_secret_runs": whole.rlike(GATE)})
    words, runs = F.col("_secret_words"), F.col("_secret_runs")
    found = gated.withColumns({f"_secret_{k}": c for k, c in enumerate(_base(whole, words, runs))} | {f"_secret_{k}": _entropy(whole, runs, k) for k in range(len(BASE), len(BASE) + len(CLASSES))})
    own = [F.col(f"_secret_{k}") for k in range(len(BASE) + len(CLASSES))]
    return found.withColumns({
        **{f"n_{x[0]}": F.size(c).cast("long") for x, c in zip(BASE, own)},
        "base_sha256": F.sha2(_joined(F.concat(*own[: len(BASE)])).cast("binary"), 256),
        "spans": _joined(F.concat(*own)),
        "secret_spans": F.array_sort(F.concat(*own)),
    }).drop("_secret_words", "_secret_runs", *(f"_secret_{k}" for k in range(len(own))))


def redacted(docs: DataFrame, *, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every span of a secret replaced by `mask`, overlapping ones together; all rows and columns stay.

    Where n_chars is a column, it is counted again for changed texts.
    """
    row, whole = F.col("_row"), F.col("_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["at"] >= s["at"]
        piece = F.substring(whole, s["at"] + 1, x["at"] - s["at"])
        return F.struct(F.greatest(s["at"], x["until"]).alias("at"), F.when(fresh, F.concat(s["out"], piece, F.lit(mask))).otherwise(s["out"]).alias("out"))

    end = F.aggregate("secret_spans", start, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole))))
    # the row goes along as one column, so that no name can clash
    scanned = scan(docs.select(F.struct("*").alias("_row"), F.col(text).cast("string").alias("_text")), "_text")
    hit = F.size("secret_spans") > 0
    changed = scanned.withColumn("_new", F.when(hit, end).otherwise(whole)).withColumn("_hit", hit)
    return changed.select(*[
        (F.col("_new") if c == text else F.when(F.col("_hit"), F.length("_new").cast(t)).otherwise(row[c]) if c == "n_chars" else row[c]).alias(c) for c, t in docs.dtypes
    ])


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir).select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans")
