"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base candidates are assignments, access keys and hexadecimal runs. The method adds
candidates of looser shapes (vendor prefixes, bearer values, key blocks, credentials
in addresses) and keeps those that look live: the hash of each
candidate is counted by distinct owners and repositories over the whole corpus, and
one that many owners carry is a copied example, one that few owners carry a live
credential. Counting is by partial aggregates, first by (hash, owner, repository),
so that a candidate copied everywhere never gathers its rows in one task.

Positions come from the lengths of the pieces between matches: split() and
regexp_extract_all() with the same pattern give alternating pieces, whose running
sums are taken in blocks, so that the work stays near linear in the matches.

Defined cases: null and empty texts have no candidates and the digest of the empty
string; a null owner or repository counts as one owner of its own; repeated rows and
repeated or null doc_ids keep their rows, each with its own spans and counts; texts are
searched whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import written

#: The base kinds in their order, pattern, group of the secret, least length of it.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: The method's kinds: pattern, group of the secret, and a literal that a text must hold.
MORE = (
    ("vendor", r"\b(gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|glpat-[A-Za-z0-9_-]{16,}|AIza[A-Za-z0-9_-]{30,})", 1, "gh|xox|sk_live_|glpat-|AIza"),
    ("bearer", r"(?i)\bbearer\x20+([A-Za-z0-9+/_.=-]{16,})", 1, "(?i)bearer"),
    ("jwt", r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*)", 1, "eyJ"),
    ("url", r"\b[a-z][a-z0-9+.-]{1,12}://[^\s:/@]+:([^\s:/@]{6,})@", 1, "://"),
    ("block", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, "-----BEGIN"),
)
_KEY = "[A-Z ]*PRIVATE KEY-----"
#: In place of the pattern in MORE, which the SQL reads: a key's whole block with its body as the secret. Where the END
#: line is missing, the body is the lines of base64 after the header; a header without a body holds no secret.
WHOLE = {
    "block": (
        rf"-----BEGIN {_KEY}(?:\s|\\[nr])*("
        rf"[^-]*+(?:-{{1,4}}[^-]++){{0,64}}(?=-----END {_KEY})"
        r"|(?:[A-Za-z0-9+/=]{16,}(?:\s|\\[nr])*){0,512}(?:[A-Za-z0-9+/]{1,15}={1,2})?)"
        rf"(?:-----END {_KEY})?",
        1,
    )
}
#: A candidate held by more owners than this is a copied example.
FEW_OWNERS = 2
_BLOCK = 128
_SPAN = "array<struct<kind:string,rank:int,s:bigint,e:bigint,secret:string>>"


def _spans(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """The matches of one kind whose secret has at least so many characters, with code point positions."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    # a struct's fields are computed once for the document, then used by the lambdas
    one = F.array(F.struct(F.transform(gaps, F.length).alias("gaps"), F.transform(whole, F.length).alias("sizes"), secret.alias("secret")))

    def place(x: Column) -> Column:
        steps = F.zip_with(F.slice(x["gaps"], 1, F.size(x["sizes"])), x["sizes"], lambda g, n: F.struct(g.alias("g"), n.alias("n")))
        return F.struct(steps.alias("steps"), x["secret"].alias("secret"))

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0).cast("bigint"), lambda n, x: n + x["g"] + x["n"])

    def blocks(x: Column) -> Column:
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(x["steps"]) - 1) / _BLOCK).cast("int")), lambda b: total(F.slice(x["steps"], b * _BLOCK + 1, _BLOCK)))
        return F.struct(x["steps"].alias("steps"), x["secret"].alias("secret"), sums.alias("sums"))

    def starts(x: Column) -> Column:
        before = F.transform(F.sequence(F.lit(0), F.size(x["sums"]) - 1), lambda b: F.aggregate(F.slice(x["sums"], 1, b), F.lit(0).cast("bigint"), lambda n, y: n + y))
        return F.struct(x["steps"].alias("steps"), x["secret"].alias("secret"), before.alias("before"))

    def rows(x: Column) -> Column:
        def row(step: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            s = F.element_at(x["before"], block + 1) + total(F.slice(x["steps"], block * _BLOCK + 1, i - block * _BLOCK)) + step["g"]
            return F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s.alias("s"), (s + step["n"]).alias("e"), F.element_at(x["secret"], i + 1).alias("secret"))

        return F.filter(F.transform(x["steps"], row), lambda y: F.length(y["secret"]) >= least)

    for step in (place, blocks, starts, rows):
        one = F.transform(one, step)
    return F.element_at(one, 1).cast(_SPAN)


def _none() -> Column:
    return F.array().cast(_SPAN)


def candidates(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """docs with two columns more: base and extra, arrays of (kind, rank, s, e, secret)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    low = F.lower(text)
    hints = {
        "assign": low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key"),
        "access": text.contains("AKIA"),
        "hex": text.rlike("[0-9a-f]{16}"),
    }
    out = docs
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        # a shorter run of one-class matches is never kept, so the pattern may ask for the length at once
        asked = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}.get(kind, pattern)
        spans = _spans(text, kind, rank, asked, group, least)
        found = text.rlike(asked) if kind != "hex" else F.lit(True)
        out = out.withColumn(f"_{kind}", F.when(hints[kind] & found, spans).otherwise(_none()))
    for rank, (kind, pattern, group, hint) in enumerate(MORE, len(BASE)):
        pattern, group = WHOLE.get(kind, (pattern, group))
        sure = F.lit(True)
        if not any(c in hint for c in "|("):
            sure = text.contains(hint)
        elif kind == "vendor":
            sure = F.reduce(F.array(*[text.contains(h) for h in hint.split("|")]), F.lit(False), lambda a, b: a | b)
        else:
            sure = low.contains(hint.replace("(?i)", ""))
        out = out.withColumn(f"_{kind}", F.when(sure & text.rlike(pattern), _spans(text, kind, rank, pattern, group, 1)).otherwise(_none()))
    base = F.concat(*[F.col(f"_{k[0]}") for k in BASE])
    extra = F.concat(*[F.col(f"_{k[0]}") for k in MORE])
    return out.withColumns({"base": base, "extra": extra}).drop(*[f"_{k[0]}" for k in (*BASE, *MORE)])


def ownership(found: DataFrame, owner: str, repository: str) -> DataFrame:
    """(hash, owners, repositories) of every candidate of the corpus."""
    rows = found.where(F.size("base") + F.size("extra") > 0).select(F.explode(F.concat("base", "extra")).alias("x"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"))
    rows = rows.select(F.sha2(F.col("x.secret"), 256).alias("hash"), "owner", "repository")
    once = rows.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("times"))
    owners = once.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"))
    return owners.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("times").alias("times"))


def _written(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"], x["rank"], x["e"], x["kind"])))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", id_column: str = "doc_id", text_column: str = "text", few_owners: int = FEW_OWNERS) -> DataFrame:
    """One row per document: id, base (its base spans), live (added spans of owner-specific candidates), n_owned and n_copied.

    n_owned and n_copied count the document's distinct candidates that at most few_owners, or more, owners carry.
    """
    names = dict.fromkeys([id_column, owner, repository, text_column])
    # a small table of its own: the texts are searched once
    found = candidates(docs.select(*names), text_column).drop(*{text_column} - {id_column, owner, repository})
    hashes = F.array_sort(F.array_distinct(F.transform(F.concat("base", "extra"), lambda x: F.sha2(x["secret"], 256))))
    found = written(found.withColumn("hashes", hashes), f"candidates-{uuid.uuid4().hex}")
    held = found.where(F.size("hashes") > 0)
    known = ownership(held, owner, repository)
    # rows of equal candidates are judged once: a row's own hashes are its key, so ids needn't tell rows apart
    sets = held.select(F.xxhash64("hashes").alias("of_key"), "hashes").distinct().withColumnRenamed("hashes", "of_hashes")
    each = sets.select("of_key", "of_hashes", F.explode("of_hashes").alias("hash"))
    judged = each.join(known, "hash").groupBy("of_key", "of_hashes").agg(F.collect_set(F.when(F.col("owners") <= few_owners, F.col("hash"))).alias("owned"))
    # rows without candidates would all meet under one key
    joined = held.join(judged, (F.xxhash64("hashes") == F.col("of_key")) & (F.col("hashes") == F.col("of_hashes"))).drop("of_key", "of_hashes")
    joined = joined.unionByName(found.where(F.size("hashes") == 0), allowMissingColumns=True)
    own = F.coalesce("owned", F.array().cast("array<string>"))
    live = F.filter("extra", lambda x: F.array_contains(own, F.sha2(x["secret"], 256)))
    return joined.select(
        F.col(id_column), "base", live.alias("live"),
        F.size(own).cast("bigint").alias("n_owned"),
        (F.size("hashes") - F.size(own)).cast("bigint").alias("n_copied"),
    )


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The figures of the contract, from what scan gives."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col(id_column), *[count(k[0]).alias(f"n_{k[0]}") for k in BASE],
        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.concat("base", "live")).alias("spans"),
        "n_owned", "n_copied",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones as one) replaced by a mark."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        piece = F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int")), F.lit(mark))
        return F.when(x["e"] <= acc["at"], acc).when(x["s"] < acc["at"], F.struct(x["e"].alias("at"), acc["out"].alias("out"))).otherwise(F.struct(x["e"].alias("at"), piece.alias("out")))

    return F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))


def brute_force(text: str | None) -> list[tuple[str, int, int]]:
    """The base spans of one text, by Python's own regular expressions; for small inputs."""
    import re

    out = []
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        for m in re.finditer(pattern.replace("(?i)", ""), text or "", (re.IGNORECASE | re.ASCII) if kind == "assign" else 0):
            if len(m[group]) >= least:
                out.append((m.start(), rank, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]
