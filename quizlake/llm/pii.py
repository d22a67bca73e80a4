"""Personal data by weak supervision (operator 8), as DataFrame expressions only.

1. Patterns find the base spans (email, ip, card, phone) and further candidates
   that the base patterns miss: tight phone and card shapes next to other digits,
   id numbers, and secrets (keys, passwords, tokens).
2. Four labelers vote on every span, for, against or not at all: a strict shape,
   a gazetteer (domains, country codes, card ranges, key prefixes), cue words in
   the text before it, and whether it stands by itself.
3. The votes are counted over the whole corpus by pattern (a table bounded by
   kinds and vote combinations); expectation-maximisation estimates how reliable
   each labeler is and how likely each pattern is personal data.
4. A naive Bayes span classifier over the votes and features of the span and its neighbours is
   trained on those probabilities (counts again, bounded by feature values). It
   decides on the further candidates; base spans always stay.

All matching runs inside each row. Patterns are written so that no text makes
them backtrack over a run twice. Positions are code points, end exclusive.

Defined cases: null and empty texts have no spans; repeated rows are rows of
their own; candidates that overlap a base span are dropped; other columns are
kept by ``redact``, whatever their names; an empty table learns nothing and
gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import fresh, let

KINDS = ["email", "ip", "card", "phone", "ssn", "secret"]  # base kinds first
N_BASE = 4
LABELERS = 4

# FIXED VALUES: the base patterns. Equal in effect to the plain forms
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ of 14 to 19 digits
#   phone \+[0-9][\x20().0-9-]+[0-9]
# but a run of local characters or digits is only tried from its start (or the
# end of the match before), so long runs cost linear time.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = f"(?:(?<!{LOCAL})|\\G){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])"
PHONE = "\\+[0-9][ ().0-9-]+[0-9]"
MORE = "|".join([
    "\\+[0-9]{1,3}[ .-]?\\(?[0-9]{2,4}\\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",          # tight phone
    "(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{2,7}(?![0-9])",                          # tight card
    "(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",                                         # id number
    "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?[^\\s\"',;]{6,}+",
    "(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Z])",                                   # access key
    "(?<![A-Za-z0-9])(?:sk|pk|ghp|gho|xoxb|xoxp|glpat)[-_][A-Za-z0-9_-]{16,}+",                # service tokens
    "(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])"])                                         # long hex

# FIXED VALUES: gazetteers and cue words
TLDS = "com|org|net|edu|gov|info|io|de|fr|es|it|uk|eu|us|ca|au|ch|at|be|nl|pl|se|no|fi|dk|pt|br|mx|jp|cn|in|ru"
COUNTRY_CODES = "1|7|20|27|3[0-469]|4[0-13-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_RANGES = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38"
PRIVATE_IP = "0|10|127|192\\.168|169\\.254|172\\.(?:1[6-9]|2[0-9]|3[01])"
CUES = "e-?mail|mail|contact|phone|tel|call|mobile|fax|card|visa|credit|pay|ip|server|host|address|ssn|social|password|token|secret|key|login|user"
AGAINST = "version|isbn|issn|order|invoice|page|section|figure|table|license|licence|copyright"

SPANS = "array<struct<start:int,rank:int,end:int,kind:string,votes:string,features:string>>"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    return let(F.split(F.reverse(_digits(s)), ""), lambda c: F.aggregate(
        F.transform(F.filter(c, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
            (x.cast("int") * 2) % 10 + F.floor(x.cast("int") / 5).cast("int"))), F.lit(0), lambda a, x: a + x) % 10 == 0)


def _before(values: Column, merge, zero: Column) -> Column:
    """For each item of an array, all items before it put together by ``merge`` (an
    associative function; ``zero`` for none). Done in blocks, and the blocks' totals
    likewise, so that long arrays do not cost the square of their length."""
    size = 256

    def fold(items):
        return F.aggregate(items, zero, merge)

    def scan(v):  # a short array: each item's own prefix
        return F.transform(v, lambda _, i: fold(F.slice(v, F.lit(1), i)))

    def blocks_of(v):
        n = F.floor((F.size(v) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda b: fold(F.slice(v, b * size + 1, F.lit(size))))

    def with_blocks(v, before):
        return F.transform(v, lambda _, i: merge(F.get(before, F.floor(i / size).cast("int")),
                                                 fold(F.slice(v, F.floor(i / size).cast("int") * size + 1, i % size))))
    def of(v):
        return let(blocks_of(v), lambda total: let(scan(total), lambda before: with_blocks(v, before)))
    return F.when(F.size(values) == 0, F.slice(F.array(zero), F.lit(1), F.lit(0))).otherwise(let(values, of))


def _starts(lengths: Column) -> Column:
    return _before(lengths, lambda a, x: a + x, F.lit(0))


PIECE = 1024


def _cutter(text: Column, body) -> Column:
    """``body(piece)`` where ``piece(start, end)`` is that part of the text. The text is
    taken apart once, into pieces of equal length, so that a part far into a long text
    does not cost a walk from its start."""
    def of(pieces):
        def piece(start, end):
            first = F.floor(start / PIECE).cast("int")
            last = F.floor(F.greatest(start, end - 1) / PIECE).cast("int")
            some = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.substring(some, start - first * PIECE + 1, end - start)
        return body(piece)
    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)


def _found(text: Column, pattern: str, worth: Column) -> Column:
    """array<struct(start, end, text)> of the matches of a pattern, in texts ``worth`` a look."""
    def placed(matches):
        def with_gaps(gaps):
            return let(_starts(F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.length(m))),
                       lambda at: F.transform(matches, lambda m, i: F.struct(
                           (F.get(at, i) + F.length(F.get(gaps, i))).alias("start"),
                           (F.get(at, i) + F.length(F.get(gaps, i)) + F.length(m)).alias("end"), m.alias("text"))))
        return F.when(F.size(matches) == 0, empty).otherwise(let(F.split(text, pattern, -1), with_gaps))
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(worth, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(empty)


def _votes(kind: Column, s: Column, before: Column, after: Column) -> Column:
    """Four letters: y for, n against, - no vote."""
    def vote(yes, no):
        return F.when(yes, F.lit("y")).when(no, F.lit("n")).otherwise(F.lit("-"))
    digits = F.length(_digits(s))
    shape = (F.when(kind == "email", s.rlike("^[A-Za-z0-9].*\\.[A-Za-z]{2,24}$")).when(kind == "ip", ~s.rlike("(?:^|\\.)0[0-9]"))
             .when(kind == "card", luhn(s)).when(kind == "phone", digits.between(10, 15))
             .when(kind == "ssn", ~s.rlike("^(?:000|666|9)")).otherwise(s.rlike("[0-9]") & s.rlike("[A-Za-z]") & (F.length(s) >= 12)))
    listed = (F.when(kind == "email", s.rlike(f"(?i)\\.(?:{TLDS})$")).when(kind == "ip", ~s.rlike(f"^(?:{PRIVATE_IP})\\."))
              .when(kind == "card", s.rlike(f"^(?:{CARD_RANGES})")).when(kind == "phone", s.rlike(f"^\\+(?:{COUNTRY_CODES})"))
              .when((kind == "secret") & s.rlike("^(?:AKIA|ASIA|sk|pk|gh[po]|xox|glpat)|[=:]"), F.lit(True)))
    alone = ~before.rlike("[A-Za-z0-9]$") & ~after.rlike("^[A-Za-z0-9]")
    return F.concat(vote(shape, ~shape), vote(listed, ~listed), vote(F.lower(before).rlike(f"\\b(?:{CUES})\\b"),
                                                                      F.lower(before).rlike(f"\\b(?:{AGAINST})\\b")), vote(alone, ~alone))


def _features(kind: Column, s: Column, before: Column, after: Column) -> Column:
    n = F.length(s)
    size = F.when(n < 12, "short").when(n < 20, "middle").when(n < 40, "long").otherwise("longer")
    share = F.length(_digits(s)) / n
    digits = F.when(share == 0, "none").when(share < 0.5, "some").when(share < 0.9, "most").otherwise("all")

    def side(x, at):
        return F.when(x == "", "edge").when(x.rlike("\\s" + at if at else "^\\s"), "space").when(x.rlike("[0-9]" + at if at else "^[0-9]"), "digit").otherwise("other")
    return F.concat_ws("|", F.concat(F.lit("kind="), kind), F.concat(F.lit("size="), size), F.concat(F.lit("digits="), digits),
                       F.concat(F.lit("before="), side(before, "$")), F.concat(F.lit("after="), side(after, "")))


def _spans(text: Column, found: Column, kind) -> Column:
    """Matches with their kind, votes and features."""
    def all_of(piece):
        def one(m):
            return let(F.struct(kind(m["text"]).alias("kind"), piece(F.greatest(F.lit(0), m["start"] - 40), m["start"]).alias("before"),
                                piece(m["end"], m["end"] + 1).alias("after")), lambda c: F.struct(
                m["start"].alias("start"), F.array_position(F.array(*(F.lit(k) for k in KINDS)), c["kind"]).cast("int").alias("rank"),
                m["end"].alias("end"), c["kind"].alias("kind"), _votes(c["kind"], m["text"], c["before"], c["after"]).alias("votes"),
                _features(c["kind"], m["text"], c["before"], c["after"]).alias("features")))
        return F.transform(found, one)
    return F.when(F.size(found) > 0, _cutter(text, all_of)).otherwise(F.array().cast(SPANS))


def _apart_from(more: Column, base: Column) -> Column:
    """The spans of ``more`` that overlap none of ``base`` (sorted by start): a sweep over
    both by start, with the largest end of the base spans so far and the start of the next."""
    far = 2**31 - 1

    def sweep(both):
        ends = F.transform(both, lambda x: F.when(x["own"], x["span"]["end"]).otherwise(0))
        nexts = F.reverse(F.transform(both, lambda x: F.when(x["own"], x["span"]["start"]).otherwise(far)))
        n = F.size(both)
        return let(_before(ends, lambda a, x: F.greatest(a, x), F.lit(0)), lambda ended: let(
            _before(nexts, lambda a, x: F.least(a, x), F.lit(far)), lambda coming: F.transform(F.filter(
                both, lambda x, i: ~x["own"] & (F.get(ended, i) <= x["span"]["start"]) & (F.get(coming, n - 1 - i) >= x["span"]["end"])),
                lambda x: x["span"])))

    def tagged(spans, own):  # at one start the base spans come first
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(not own).alias("later"), F.lit(own).alias("own"), x.alias("span")))
    either = (F.size(more) > 0) & (F.size(base) > 0)
    return F.when(either, let(F.array_sort(F.concat(tagged(base, True), tagged(more, False))), sweep)).otherwise(more)


def _more_kind(s: Column) -> Column:
    return (F.when(s.startswith("+"), "phone").when(s.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(s.rlike("^[0-9][0-9 -]*$"), "card").otherwise("secret"))


def candidates(text: Column) -> Column:
    """struct(base, more): the base spans by start and kind, and what else may be one."""
    def of(t):
        has_digit = t.rlike("[0-9]")
        email = _found(t, EMAIL, F.contains(t, F.lit("@")))
        ip = F.filter(_found(t, IP, has_digit), lambda m: m["text"].rlike(f"^{OCTET}(?:\\.{OCTET}){{3}}$"))
        card = F.filter(_found(t, CARD, has_digit), lambda m: luhn(m["text"]))
        phone = F.filter(_found(t, PHONE, F.contains(t, F.lit("+"))), lambda m: F.length(_digits(m["text"])).between(10, 15))
        base = F.array_sort(F.concat(*(_spans(t, f, lambda s, k=k: F.lit(k)) for k, f in zip(KINDS, (email, ip, card, phone)))))
        more = _spans(t, _found(t, MORE, t.rlike("[0-9=:]")), _more_kind)
        return F.struct(base.alias("base"), more.alias("more"))
    return let(F.coalesce(text, F.lit("")), of)


def with_spans(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with the column ``name``: the base spans and the candidates apart from them.
    Step by step, as one expression would be nested too deeply for the analyzer."""
    raw = fresh(docs, f"{name}_raw")
    found = docs.withColumn(raw, candidates(F.col(f"`{text_col}`")))
    base, more = F.col(f"`{raw}`.base"), F.col(f"`{raw}`.more")
    return found.withColumn(name, F.struct(base.alias("base"), _apart_from(more, base).alias("more"))).drop(raw)


def fit(patterns: list[tuple[str, str, str, int]], rounds: int = 100) -> dict[str, float]:
    """Log odds by feature value ("" for the prior) from (kind, votes, features,
    count) rows. EM over the vote patterns: one prior a kind, and for each labeler
    how often it votes yes on personal data and on other spans."""
    if not patterns:
        return {"": 0.0}
    by_votes: dict[tuple[str, str], float] = {}
    for kind, votes, _, n in patterns:
        by_votes[kind, votes] = by_votes.get((kind, votes), 0) + n
    width = len(patterns[0][1])
    post = {k: (1 + 2 * k[1].count("y")) / (2 + 2 * (k[1].count("y") + k[1].count("n"))) for k in by_votes}
    for _ in range(rounds):
        prior, right, wrong = {}, [], []
        for kind in {k for k, _ in by_votes}:
            own = [(post[x], n) for x, n in by_votes.items() if x[0] == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j in range(width):
            cast = [(x, n) for x, n in by_votes.items() if x[1][j] != "-"]
            right.append((4 + sum(post[x] * n for x, n in cast if x[1][j] == "y")) / (5 + sum(post[x] * n for x, n in cast)))
            wrong.append((1 + sum((1 - post[x]) * n for x, n in cast if x[1][j] == "y")) / (5 + sum((1 - post[x]) * n for x, n in cast)))
        for kind, votes in by_votes:
            odds = math.log(prior[kind] / (1 - prior[kind]))
            for j, v in enumerate(votes):
                odds += 0 if v == "-" else math.log(right[j] / wrong[j]) if v == "y" else math.log((1 - right[j]) / (1 - wrong[j]))
            post[kind, votes] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    total = [1.0 + sum(post[k, v] * n for k, v, _, n in patterns), 1.0 + sum((1 - post[k, v]) * n for k, v, _, n in patterns)]
    share = total[0] / sum(total)  # one pseudo-count a value, split like the classes: a rare value says little
    yes, no = {}, {}
    for kind, votes, features, n in patterns:
        p = post[kind, votes]
        for f in [*features.split("|"), *(f"vote{j}={v}" for j, v in enumerate(votes))]:
            yes[f], no[f] = yes.get(f, share) + p * n, no.get(f, 1 - share) + (1 - p) * n
    return {"": math.log(total[0] / total[1])} | {f: math.log(yes[f] / total[0]) - math.log(no[f] / total[1]) for f in sorted(yes)}


def learn(found: DataFrame) -> dict[str, float]:
    """The classifier for a table with a column ``spans`` of ``candidates``. The
    counts that come to the driver are bounded by kinds, votes and feature values."""
    each = found.select(F.explode(F.concat("spans.base", "spans.more")).alias("s"))
    counts = each.groupBy(F.col("s.kind").alias("kind"), F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).count()
    return fit(sorted((r["kind"], r["votes"], r["features"], r["count"]) for r in counts.collect()))


def accepted(spans: Column, odds: dict[str, float]) -> Column:
    """Base spans and the candidates that the classifier takes, by start and kind."""
    table = F.create_map(*(F.lit(x) for f, v in odds.items() for x in (f, v)))

    def taken(m):
        votes = F.array(*(F.concat(F.lit(f"vote{j}="), F.substring(m["votes"], j + 1, 1)) for j in range(LABELERS)))
        score = F.aggregate(F.concat(F.split(m["features"], "\\|"), votes), F.lit(odds[""]),
                            lambda a, f: a + F.coalesce(F.element_at(table, f), F.lit(0.0)))
        return score >= 0
    return F.array_sort(F.concat(spans["base"], F.filter(spans["more"], taken)))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans per document.
    One pass over the texts; what is learned from and written out are its spans."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = stage(with_spans(rows, "text", "spans").select("doc_id", "spans"), "pii-spans")
    odds = learn(found)
    base = F.col("spans.base")

    def number_of(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [number_of(k) for k in KINDS[:N_BASE]]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
                        _written(accepted(F.col("spans"), odds)).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The documents with each span replaced by its kind, like ``<EMAIL>`` (of
    spans that overlap, the first names the kind), their length counted anew."""
    text = F.col(f"`{text_col}`")
    odds = learn(stage(with_spans(docs.select(text.alias("text")), "text", "spans").select("spans"), "pii-spans"))

    def cut(spans):
        """Pieces between the spans, each followed by the next span's mark: span i takes the
        text from the largest end before it, and no mark if it begins before that end."""
        def joined(piece):
            def with_ends(ended):
                def part(x, i):
                    return F.when(x["start"] >= F.get(ended, i), F.concat(piece(F.get(ended, i), x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
                last = F.greatest(F.get(ended, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["end"])
                return F.concat(F.array_join(F.transform(spans, part), ""), piece(last, F.length(text)))
            return let(_before(F.transform(spans, lambda x: x["end"]), lambda a, x: F.greatest(a, x), F.lit(0)), with_ends)
        return _cutter(text, joined)
    name, spans = fresh(docs, "__clean"), fresh(docs, "__spans")
    out = with_spans(docs, text_col, spans).withColumn(spans, accepted(F.col(spans), odds))
    out = out.withColumn(name, F.when(F.size(F.col(spans)) == 0, text).otherwise(cut(F.col(spans))))
    new = {text_col: F.col(name)}
    if length_col in docs.columns:
        new[length_col] = F.length(name).cast(docs.schema[length_col].dataType)
    return out.select(*((new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in docs.columns))
