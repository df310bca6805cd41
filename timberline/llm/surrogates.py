"""Personal data replaced by surrogates, with DataFrame functions alone.

Entities are found by patterns. Each distinct entity of the corpus gets one surrogate of its
kind and format, derived from a secret key: digits stay digits, letters stay letters of
their case and script, addresses stay valid, card numbers keep their issuer and check
digit, names keep their title, gender and script. So one entity has one surrogate in all
documents, whatever case or separators a mention uses. Surrogates that would meet
each other or a real entity are drawn again until all are distinct; after some draws they
get longer each time (an ip address one of version 6), so no space of values can fill up.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.session import written

_MALE = r"Mr|Herr|M|Sr|Señor|Monsieur|г-н"
_FEMALE = r"Mrs|Ms|Miss|Frau|Mme|Mlle|Sra|Srta|Señora|Madame|г-жа"
_NAME = r"\p{Lu}\p{Ll}+(?:[-' ]\p{Lu}\p{Ll}+){0,2}"

# Kinds in the order in which they claim a text; a match is of the first kind that fits it whole.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9])|\G)[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?i:password|passwd|secret|token|api_key)=[^\s\"'&]+"
    r"|(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name_m": rf"(?<!\p{{L}})(?:{_MALE})\.? {_NAME}",
    "name_f": rf"(?<!\p{{L}})(?:{_FEMALE})\.? {_NAME}",
}
PLAIN = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Where a pattern can match at all: no letter or digit before, a digit or sign next, a digit or a
# match before, or a key of a secret next. So most letters are passed over at once, and nothing that
# a pattern allows is; a pattern's own lookbehind decides what it may be glued to.
_WHERE = r"(?=[A-Za-z0-9+(г])(?:(?<![A-Za-z0-9])|(?=[0-9+(])|(?<=[0-9])|\G|(?=[PSTApsta](?i:assword|asswd|ecret|oken|pi_key)=))"
ANY = f"{_WHERE}(?:{PLAIN})"
# What a text with an entity must hold at least: a digit, an address or a value, what may be a
# title before a capital, or a key without a digit. That tells most texts apart from those the patterns must read.
GATES = (r"[0-9@=]", r"[MHFSг][\p{Ll}-]{0,7}\.? \p{Lu}|AKIA|[a-f]{32}")
_TITLE = rf"^(?:{_MALE}|{_FEMALE})\.? "
_DIGITS = ("card", "ssn", "phone")
# Draws in an entity's own form, and the characters that each later draw adds.
_PLAIN_DRAWS = 6
_LONGER = 8

_LATIN = ("ba be bi bo da de di do fa fe ga ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se ta te ti to va ve vi".split())
_CYRILLIC = ("ба бе ви во га да де ди до ка ке ла ле ли ло ма ме ми мо на не ни но па ра ре ри ро са се та те ти то ва за зо жа".split())


def kind_of(match: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(match.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def canonical(kind: Column, match: Column) -> Column:
    """What all mentions of one entity have in common."""
    return (
        F.when(kind.isin(*_DIGITS), F.concat(F.regexp_extract(match, r"^(\+?)", 1), F.regexp_replace(match, "[^0-9]", "")))
        .when(kind == "email", F.lower(match))
        .when(kind == "iban", F.regexp_replace(match, " ", ""))
        .when(kind.startswith("name"), F.lower(F.regexp_replace(match, _TITLE, "")))
        .otherwise(match)
    )


def _number(digest: Column, i: Column | int) -> Column:
    """The i-th byte of a digest in hex, from 0, going round."""
    at = (F.lit(i) if isinstance(i, int) else i) % 64 * 2 + 1
    return F.conv(F.substring(digest, at, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))


def _characters(
    value: Column, digest: Column, keep: Callable[[Column], Column] | None = None, also: Callable[[Column], Column] | None = None
) -> Column:
    """Every character replaced by one of its class; others, and those ``keep`` names by place, stay.
    Where ``also`` holds of such another character, it becomes a letter."""

    def one(c: Column, i: Column) -> Column:
        n = _number(digest, i)
        hexadecimal = value.rlike("^[0-9a-f]+$")
        out = (
            F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
            .when(c.rlike("^[a-f]$") & hexadecimal, _pick("abcdef", n))
            .when(c.rlike("^[a-z]$"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("^[A-Z]$"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
        )
        if also:
            out = out.when(also(c), _pick("abcdefghijklmnopqrstuvwxyz", n))
        out = out.otherwise(c)
        return F.when(keep(i), c).otherwise(out) if keep else out

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _check_digit(payload: Column) -> Column:
    """The last digit that makes a card number valid."""
    digits = F.reverse(F.split(payload, ""))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int") * 2).otherwise(d.cast("int")))
    total = F.aggregate(doubled, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0))
    return ((10 - total % 10) % 10).cast("string")


def _name(value: Column, kind: Column, digest: Column, tail: Column, more: int) -> Column:
    """As many words as the name has, of syllables of its script, the first with its gender's ending
    and ``more`` further syllables drawn from ``tail``."""

    def word(w: Column, i: Column, syllables: list[str], male: str, female: str) -> Column:
        table = F.array(*map(F.lit, syllables))
        # 16-bit draws: neighbouring bytes, three syllables a word
        part = [F.element_at(table, (_number(digest, i * 7 + 2 * k) * 256 + _number(digest, i * 7 + 2 * k + 1)) % len(syllables) + 1) for k in range(3)]
        end = F.when(i > 0, "").when(kind == "name_f", female).otherwise(male)
        if more:
            longer = [F.element_at(table, _number(tail, k) % len(syllables) + 1) for k in range(more)]
            end = F.concat(F.when(i > 0, "").otherwise(F.concat(*longer)), end)
        return F.concat(*part, end)

    words = F.split(value, "[ ]")
    latin = F.array_join(F.transform(words, lambda w, i: word(w, i, _LATIN, "n", "na")), " ")
    cyrillic = F.array_join(F.transform(words, lambda w, i: word(w, i, _CYRILLIC, "н", "на")), " ")
    return F.when(value.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(latin)


def surrogate(kind: Column, value: Column, key: str, draw: int) -> Column:
    """The surrogate of a canonical entity at one draw.

    The first draws keep the entity's form. Each later one is ``_LONGER`` characters
    (or syllables) longer than the one before, so the space grows by 10 ** 8 at least.
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(draw))), 512)
    more = max(0, draw - _PLAIN_DRAWS + 1) * _LONGER
    tail = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, F.lit(str(draw)), F.lit("more")), 512)
    letters = F.substring(tail, 1, more) if more else F.lit("")
    digits = F.translate(letters, "abcdef", "012345")
    code = F.length(F.regexp_extract(value, r"^(\+[0-9]{0,1})", 1))
    local = F.regexp_extract(value, r"^(.*)\.[^.]*$", 1)
    top = F.regexp_extract(value, r"(\.[^.]*)$", 1)
    address = _characters(local, digest)
    payload = _characters(F.substring(value, F.lit(1), F.length(value) - 1), digest, lambda i: i < 1)
    octets = F.concat_ws(".", *[(_number(digest, i) % 254 + 1).cast("string") for i in range(4)])
    if more:
        address = F.regexp_replace(address, F.lit("@"), F.concat(letters, F.lit("@")))
        payload = F.concat(payload, digits)
        octets = F.concat_ws(":", F.concat(F.lit("fd"), F.substring(tail, 1, 2)), *[F.substring(tail, 4 * i - 1, 4) for i in range(1, 8)])
    prefix = F.length(F.regexp_extract(value, r"^(AKIA|[A-Za-z_]+=)", 1))
    # A secret without a letter or digit of ASCII, such as ****, would be its own surrogate.
    signs = ~F.substring(value, prefix + 1, F.length(value)).rlike("[0-9A-Za-z]") | F.lit(more > 0)
    hidden = _characters(value, digest, lambda i: i < prefix, lambda c: signs | c.rlike(r"^[^\x00-\x7F]$"))
    return (
        F.when(kind == "email", F.concat(address, top))
        .when(kind == "ip", octets)
        .when(kind == "card", F.concat(payload, _check_digit(payload)))
        .when(kind == "phone", F.concat(_characters(value, digest, lambda i: i < code), digits))
        .when(kind == "secret", F.concat(hidden, letters))
        .when(kind == "iban", F.concat(_characters(value, digest, lambda i: i < 2), digits))
        .when(kind.startswith("name"), _name(value, kind, digest, tail, more))
        .otherwise(F.concat(_characters(value, digest), digits))
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(``kind``, ``value``, ``surrogate``) with no surrogate twice and none that is a real value.

    Each round draws for the values still open and keeps the draws that meet neither an
    entity, nor an earlier surrogate, nor a lesser value of the same round. Surrogates
    get longer from round to round in the end, so the rounds come to an end for any entities.
    """
    entities, _ = written(entities.select("kind", "value").distinct(), "entities")
    real = entities.select("kind", F.col("value").alias("surrogate"))
    done, pending = None, entities
    for draw in count():
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, draw))
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        kept, _ = written(
            drawn.groupBy("kind", "surrogate").agg(F.min("value").alias("value"))
            .join(taken, ["kind", "surrogate"], "left_anti").select("kind", "value", "surrogate"),
            "kept",
        )
        done = kept if done is None else done.union(kept)
        pending, _ = written(pending.join(kept, ["kind", "value"], "left_anti"), "pending")
        if pending.isEmpty():
            return done


def rendered(kind: Column, match: Column, new: Column) -> Column:
    """A surrogate in the form of a mention: its separators, its case, its title."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))
    digits = F.regexp_replace(new, "[^0-9]", "")
    alnum = F.regexp_replace(new, " ", "")

    def fill(stream: Column, slot: str) -> Column:
        def step(a: Column, c: Column) -> Column:
            is_slot = c.rlike(slot)
            text = F.concat(a["text"], F.when(is_slot, F.substring(stream, a["next"], F.lit(1))).otherwise(c))
            return F.struct(text.alias("text"), (a["next"] + is_slot.cast("int")).alias("next"))

        rest = lambda a: F.substring(stream, a["next"], F.length(stream))  # noqa: E731  what a longer surrogate has left
        return F.aggregate(F.split(match, ""), start, step, lambda a: F.concat(a["text"], rest(a)))

    cased = F.array_join(
        F.zip_with(F.split(match, ""), F.split(new, ""), lambda c, s: F.when(c.rlike(r"^\p{Lu}$"), F.upper(s)).otherwise(s)), ""
    )
    return (
        F.when(kind.isin(*_DIGITS), fill(digits, "^[0-9]$"))
        .when(kind == "iban", fill(alnum, "^[0-9A-Z]$"))
        .when(kind == "email", cased)
        .when(kind.startswith("name"), F.concat(F.regexp_extract(match, _TITLE, 0), F.initcap(new)))
        .otherwise(new)
    )


def replace_entities(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replace every entity by its surrogate.

    Returns (``id_col``, ``text``, ``n_entities``), one row per input row. Texts without an entity
    are unchanged, a null text stays null with 0 entities. Rows that repeat and null ids are rows like
    others. Other columns are not read. An empty table gives an empty table. ``key`` is the secret:
    the same key gives the same surrogates for the same set of entities.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    any_entity = F.lit(ANY)
    found = F.regexp_extract_all("text", any_entity, F.lit(0))
    gate = F.col("text").rlike(GATES[0]) | F.col("text").rlike(GATES[1])
    some = F.coalesce(F.when(gate, F.col("text").rlike(ANY)), F.lit(False))
    held = rows.where(some).withColumn("_key", F.xxhash64("text"))
    mentions = (
        held.select("_key", F.explode(F.array_distinct(found)).alias("match"))
        .distinct()
        .withColumn("kind", kind_of(F.col("match")))
        .withColumn("value", canonical(F.col("kind"), F.col("match")))
    )
    # A scratch table, which goes with the driver: it holds raw values.
    mentions, _ = written(mentions, "mentions")
    new = distinct_surrogates(mentions, key)
    tables = (
        mentions.join(new, ["kind", "value"])
        .select("_key", "match", rendered(F.col("kind"), F.col("match"), F.col("surrogate")).alias("shown"))
        .groupBy("_key")
        .agg(F.map_from_entries(F.collect_set(F.struct("match", "shown"))).alias("shown"))
    )
    between = F.split("text", ANY, -1)
    joined = F.array_join(
        F.zip_with(between, found, lambda p, m: F.concat(F.coalesce(p, F.lit("")), F.coalesce(F.col("shown")[m], F.lit("")))), ""
    )
    changed = held.join(tables, "_key").select("_id", joined.alias("text"), F.size(found).cast("bigint").alias("n_entities"))
    same = rows.where(~some).select("_id", "text", F.lit(0).cast("bigint").alias("n_entities"))
    return changed.unionByName(same).withColumnRenamed("_id", id_col)
