"""Operator 10 [native]: secret scans with multipart credential linking.

Base secrets are found by pattern. Weak candidates (identifiers, short or unlabelled secrets,
endpoints) are common in clean text, so they count only where complementary parts co-occur: the
candidates and base spans of a text, in order of position, are interval-joined within a scope of
SCOPE characters by one forward and one backward merge. Column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

#: Characters of the chunks that a text is cut into before pieces are taken from it.
CHUNK = 4096
#: Characters between two parts of one credential at most.
SCOPE = 240

#: The base patterns; letters of ASSIGN's names in either case. Runs are maximal, so
#: their least length can stand in the pattern; ASSIGN's cannot, as short matches also use up text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Weak parts: a named account or key id; a named short secret, also under ASSIGN's names where the value fails the base rule
#: (read up to white space or a quote), the userinfo of a URL if it holds a password or is as long as a token, a bare
#: 40-character secret; a service address. Values are possessive runs without an upper bound: spans and gaps are measured from their real ends.
IDENTIFIER = r"""(?i)\b(?:access[_-]?key[_-]?id|client[_-]?id|user(?:name|[_-]?id)?|login|account)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9@._+-]{3,}+"""
WEAK_SECRET = (
    r"""(?i)\b(?:pass|pwd|passphrase|credential|private[_-]?key|auth)["']?\x20{0,8}[:=]\x20{0,8}["']?[^\s"']{4,}+"""
    r"""|(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?![A-Za-z0-9+/_.=-]{12})[^\s"']++"""
    r"""|(?<=[a-z0-9+.-]://)(?:[^\s"'<>/?#:@]*+:[^\s"'<>/?#]+|[^\s"'<>/?#:@]{20,}+)(?=@)"""
    r"""|(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_.-])"""
)
ENDPOINT = r"""(?i)\b[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]++|\b(?:host|hostname|endpoint|server)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9.-]{3,}+(?::[0-9]{1,5})?"""
#: Kinds in the order in which spans with one start are listed; a role completes the others.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ROLES = {"assign": "secret", "access": "identifier", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}


def spans_of(text: Column, kind: str, pattern: str, least: int = 0, quick: str | None = None) -> Column:
    """array<struct<s, o, e, role, weak>> of a pattern's matches: offsets in code points from the lengths of gaps and matches.

    Matches whose group 2 is shorter than ``least`` are left out. Texts without any match (by ``quick``) are not taken apart.
    """
    order, role, weak = KINDS.index(kind), ROLES[kind], kind in KINDS[3:]
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda v: F.length(v) >= least) if least else F.transform(found, lambda v: F.lit(True))

    def placed(parts: Column) -> Column:
        before = running(F.transform(parts, lambda x: x["gap"] + x["m"]), "int", F.lit(0), lambda a, b: a + b)

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.when(x["ok"], F.struct(start.alias("s"), F.lit(order).alias("o"), (start + x["m"]).alias("e"), F.lit(role).alias("role"), F.lit(weak).alias("weak")))

        return F.filter(F.zip_with(parts, before, span), lambda x: x.isNotNull())

    lengths = lambda v: F.transform(v, F.length)
    parts = F.arrays_zip(F.slice(lengths(gaps), 1, F.size(found)).alias("gap"), lengths(found).alias("m"), long_enough.alias("ok"))
    empty = F.array().cast("array<struct<s:int,o:int,e:int,role:string,weak:boolean>>")
    return F.when(text.rlike(quick or pattern), let(parts, placed)).otherwise(empty)


def linked(spans: Column, scope: int) -> Column:
    """``spans`` (sorted) without the weak ones whose complement is nowhere within ``scope`` characters.

    A secret needs an identifier or an endpoint; an identifier or an endpoint needs a secret. The farthest end so far of
    either side is a running maximum, taken once from the front and, with starts and minima, once from the back.
    """

    def near(ordered: Column, forward: bool) -> Column:
        far = F.lit(-(1 << 30)) if forward else F.lit(1 << 30)
        secret = lambda x: x["role"] == "secret"
        edge = lambda x: x["e"] if forward else x["s"]
        sides = F.transform(ordered, lambda x: F.struct(F.when(secret(x), edge(x)).otherwise(far).alias("own"), F.when(secret(x), far).otherwise(edge(x)).alias("other")))
        best = F.greatest if forward else F.least
        reach = running(sides, "struct<own:int,other:int>", F.struct(far.alias("own"), far.alias("other")), lambda a, b: F.struct(best(a["own"], b["own"]).alias("own"), best(a["other"], b["other"]).alias("other")))

        def ok(x: Column, r: Column) -> Column:
            to = F.when(secret(x), r["other"]).otherwise(r["own"])
            return (x["s"] - to <= scope) if forward else (to - x["e"] <= scope)

        return F.zip_with(ordered, reach, ok)

    def kept(own: Column) -> Column:
        flagged = F.arrays_zip(own.alias("x"), near(own, True).alias("b"), F.reverse(near(F.reverse(own), False)).alias("a"))
        return F.transform(F.filter(flagged, lambda f: ~f["x"]["weak"] | f["b"] | f["a"]), lambda f: f["x"])

    return let(spans, lambda own: F.when(F.exists(own, lambda x: x["weak"]), kept(own)).otherwise(own))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["o"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def spans_in(text: Column, scope: int = SCOPE) -> Column:
    """array<struct<s, o, e, role, weak>> of a text, by start and then kind; none for null. Texts that hold no part cost one search a pattern."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    parts = (
        spans_of(text, "assign", ASSIGN, 12),
        spans_of(text, "access", ACCESS),
        spans_of(text, "hex", HEX),
        spans_of(text, "identifier", IDENTIFIER),
        spans_of(text, "secret", WEAK_SECRET),
        spans_of(text, "endpoint", ENDPOINT),
    )
    return linked(F.array_sort(F.concat(*parts)), scope)


def scan(df: DataFrame, id_col: str, text_col: str, scope: int = SCOPE) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans): counts and digest of base spans, and all spans.

    Null text counts as empty. Null and repeated ids stay, a row each; other columns are not carried; an empty
    table gives an empty result. One narrow pass, in time that grows with a text's length and spans.
    """
    found = df.select(F.col(id_col).alias("id"), spans_in(F.col(text_col), scope).alias("spans"))
    spans = F.col("spans")
    n = lambda kind: F.size(F.filter(spans, lambda x: x["o"] == KINDS.index(kind))).cast("long")
    base = F.filter(spans, lambda x: x["o"] < 3)
    return found.select(F.col("id").alias(id_col), n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(spans).alias("spans"))


def redact(df: DataFrame, text_col: str, mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """``df`` with every secret and access key in ``text_col`` replaced by ``mark``; overlapping spans share one mark.

    Null text stays null; all other columns and rows stay, whatever their names. Pieces of a text are cut from
    chunks of it, so that a piece far from the start costs no more than one near it.
    """
    text = F.col(text_col)

    def covered(hide: Column, chunks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / CHUNK).cast("int")
            own = F.array_join(F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(own, start % CHUNK + 1, end - start)).otherwise("")

        reach = running(F.transform(hide, lambda x: x["e"]), "int", F.lit(0), F.greatest)
        pieces = F.zip_with(hide, reach, lambda x, at: F.when(x["s"] >= at, F.concat(piece(at, x["s"]), F.lit(mark))).otherwise(""))
        last = F.array_max(F.transform(hide, lambda x: x["e"]))
        return F.concat(F.array_join(pieces, ""), piece(last, F.length(text)))

    def clean(hide: Column) -> Column:
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
        return F.when(F.size(hide) > 0, let(chunks, lambda c: covered(hide, c))).otherwise(text)

    hidden = F.filter(spans_in(text, scope), lambda x: (x["role"] == "secret") | (x["o"] == 1))
    return df.withColumn(text_col, F.when(text.isNotNull(), let(hidden, clean)))
