"""Linking variant spellings of the names of people and firms.

Spellings are reduced to word sets (case, order, punctuation, legal forms, post-nominals, usual abbreviations and nicknames put
aside); equal sets are one identity. Identities that differ by a typing slip are found by suffix blocking: every word is indexed by
its suffixes; identities of a suffix met in too many meet by the other words and a word less one letter instead, which every two that
are one slip apart share. Candidate pairs are compared by the ratio of the longest common subsequence.
A rarer identity joins the closest commoner one. Spellings with initials join the only identity they fit.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstack.operators.lineage import Scratch, scratch

#: Shortest suffix indexed, most identities of a block before it is refined.
SHORTEST, COMMON = 4, 40
#: Forms an identity may have and still be a slip of another.
ESTABLISHED = 2
#: Least ratio of the longest common subsequence of two unequal words.
RATIO = 0.75
#: The same where two or more other words are equal, as in names of firms.
SHORT_RATIO = 0.6

# Legal forms, words without weight, post-nominals and titles.
LEGAL = "inc incorporated corp corporation co company llc llp lp plc pllc ltd limited pc pa gmbh ag sa sarl sl srl kg"
EMPTY = "the and of for y et und de la"
TITLES = "mr mrs ms miss dr prof sir hon esq esquire jr sr ii iii iv phd md jd cpa qc kc dds rn"
# Usual abbreviations in firm names.
SHORT = """acct accounting; adj adjusters; admin administration; agcy agency; amer american; apts apartments; assn association; assoc associates; assocs associates;
atty attorneys; attys attorneys; bldg building; bldrs builders; bros brothers; bus business; ctr center; constr construction; const construction;
cons consultants; consult consultants; consltg consulting; contr contractors; dept department; dev development; dist distribution; div division;
elec electric; eng engineering; engg engineering; engr engineering; engrg engineering; engrs engineers; ent enterprises; env environmental; envtl environmental;
envir environmental; equip equipment; esc escrow; est estate; fin financial; finl financial; fincl financial; gen general; govt government; grp group; gp group;
hldgs holdings; hldg holdings; hosp hospital; htg heating; inds industries; ind industries; ins insurance; insp inspection; inst institute; intl international;
inv investments; invs investments; lab laboratory; labs laboratories; mfg manufacturing; med medical; mgmt management; mgt management; mktg marketing;
mtg mortgage; natl national; ofc office; ofcs offices; off offices; plbg plumbing; plmbg plumbing; prop property; props properties; ptnrs partners; ptrs partners;
pty property; rlty realty; re realty; res residential; resid residential; residl residential; rfg roofing; roofg roofing; sec security; serv services; servs services;
svc service; svcs services; sol solutions; solns solutions; sys systems; tech technology; test testing; tstg testing; trans transport; ttl title; univ university"""
# Nicknames of given names.
NICK = """abby abigail; abbie abigail; al albert; alex alexander; sandy alexander; xander alexander; andy andrew; drew andrew; ange angela; annie anne; tony anthony;
art arthur; barb barbara; becky rebecca; becca rebecca; ben benjamin; benny benjamin; benji benjamin; bern bernard; bernie bernard; beth elizabeth; betty elizabeth; betsy elizabeth; bess elizabeth;
eliza elizabeth; liz elizabeth; lizzie elizabeth; libby elizabeth; lisa elizabeth; bill william; billy william; will william; willy william; bob robert; bobby robert; rob robert; robbie robert;
brad bradley; cathy catherine; cat catherine; chad charles; charlie charles; chuck charles; chris christopher; topher christopher; cindy cynthia; dan daniel; danny daniel; dave david; davy david;
deb deborah; debbie deborah; debby deborah; dick richard; rich richard; rick richard; ricky richard; richie richard; dom dominic; don donald; donnie donald; dot dorothy; doug douglas; ed edward; eddie edward; ned edward; ted edward; teddy theodore; theo theodore;
fran frances; frank francis; paco francisco; pancho francisco; cisco francisco; fred frederick; freddie frederick; freddy frederick; gabe gabriel; gene eugene; geoff geoffrey; gerry gerald; jerry gerald; ginny virginia; greg gregory;
gwen gwendolyn; wendy gwendolyn; hal harold; harry harold; hank henry; ike isaac; bella isabella; izzy isabella; ibby isabella; jack john; johnny john; jake jacob; jamie james; jim james; jimmy james; jeff jeffrey; jen jennifer; jenny jennifer; jenn jennifer;
jess jessica; jessie jessica; joe joseph; joey joseph; jos joseph; jon jonathan; jonny jonathan; josh joshua; judy judith; julie julia; kate katherine; katie katherine; kathy katherine; kat katherine; kay katherine;
ken kenneth; kenny kenneth; kim kimberly; larry lawrence; len leonard; lenny leonard; leo leonard; les leslie; lou louis; maggie margaret; meg margaret; peg margaret; peggy margaret; marge margaret; margie margaret;
mandy amanda; marty martin; matt matthew; matty matthew; mick michael; mike michael; mickey michael; mikey michael; nick nicholas; nicky nicholas; nico nicholas; ollie oliver; pam pamela; pat patricia; patty patricia; tricia patricia; trish patricia; pete peter;
phil philip; ray raymond; reg reginald; ron ronald; ronnie ronald; sally sarah; sam samuel; sammy samuel; steph stephanie; stephie stephanie; steve steven; stevie steven; stu stuart; sue susan; susie susan; suzy susan; tim timothy; tom thomas; tommy thomas;
tina christina; val valerie; vic victoria; vicky victoria; vicki victoria; tori victoria; vin vincent; vince vincent; vinny vincent; walt walter; zach zachary; zack zachary; zak zachary; quent quentin; lola dolores; pepe jose; yoli yolanda"""


def pairs_of(text: str) -> dict[str, str]:
    return dict(p.split() for p in text.replace("\n", " ").split(";"))


def folded(text: str) -> str:
    """Lower case without marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


_DOTS = regex.compile(r"\b(?:\w\.\s?){2,}")
_WORD = regex.compile(r"\w+")


def words_of(text: str, kind: str, nick: dict, short: dict, drop: frozenset, legal: frozenset) -> tuple[list[str], str]:
    """(sorted whole words, initials in their order) of one spelling."""
    low = folded(text).replace("'", "").replace("’", "")
    if kind == "ORG":
        low = _DOTS.sub(lambda m: m[0].replace(".", "").replace(" ", "") + " ", low)
        every = [short.get(w, w) for w in _WORD.findall(low)]
        some = [w for w in every if w not in drop and w not in legal]
        return sorted(some or every), ""
    every = [w for w in _WORD.findall(low) if w not in drop]
    whole = [nick.get(w, w) for w in every if len(w) > 1]
    return sorted(whole), "".join(w for w in every if len(w) == 1)


def spellings(mentions: DataFrame) -> DataFrame:
    """Distinct (kind, name, n, words, initials) of PERSON and ORG mentions. Null or blank texts take no part."""
    names = mentions.where(F.col("entity_type").isin("PERSON", "ORG") & (F.trim("entity_text") != "")).groupBy(
        F.col("entity_type").alias("kind"), F.col("entity_text").alias("name")
    ).agg(F.count(F.lit(1)).alias("n"))
    nick, short = pairs_of(NICK), pairs_of(SHORT)
    legal, drop = frozenset(LEGAL.split()), frozenset(EMPTY.split())
    titles = frozenset(TITLES.split())

    def split(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [words_of(t, k, nick, short, drop if k == "ORG" else titles, legal) for t, k in zip(part["name"], part["kind"])]
            yield part.assign(words=[g[0] for g in got], initials=[g[1] for g in got])

    return names.mapInPandas(split, "kind string, name string, n long, words array<string>, initials string")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = s & where.get(c, 0)
        s = ((s + m) | (s - m)) & full
    return len(a) - s.bit_count()


def slip(a: list[str], b: list[str]) -> float:
    """Ratio of the longest common subsequence if the word lists differ in one word by a typing slip, else 0.

    A slip adds, drops or changes one letter or swaps two neighbours: the common subsequence lacks one letter of the longer word.
    """
    left, right = list(a), list(b)
    for w in a:
        if w in right:
            left.remove(w)
            right.remove(w)
    if len(left) != 1 or len(right) != 1:
        return 0.0
    x, y = left[0], right[0]
    common = lcs(x, y)
    if max(len(x), len(y)) - common > 1 or abs(len(x) - len(y)) > 1:
        return 0.0
    ratio = 2 * common / (len(x) + len(y))
    return ratio if ratio >= (RATIO if len(a) < 3 else SHORT_RATIO) else 0.0


def slip_keys(words: str) -> Column:
    """The word list with one word marked, whole and less each of its letters: two lists that differ by one slip share such a key.

    Of two words one slip apart, both less a letter, or one less a letter and the other whole, are equal. The marked word stands behind the others.
    """
    less = F.expr(f"flatten(transform({words}, (w, i) -> transform(sequence(0, length(w)), k -> concat(array_join(filter({words}, (u, j) -> j <> i), ' '), '#', if(k = 0, w, concat(left(w, k - 1), substring(w, k + 1)))))))")
    return F.array_distinct(less)


def blocked_pairs(people: DataFrame) -> DataFrame:
    """Candidate pairs (a < b) of identities (id, words) by suffix blocks, those of common suffixes by ``slip_keys``."""
    each = people.select("id", F.explode(F.array_distinct("words")).alias("w"))
    keys = each.select("id", F.explode(F.expr(f"transform(sequence(least({SHORTEST}, length(w)), length(w)), k -> right(w, k))")).alias("suffix")).distinct()
    counts = keys.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"))
    marked = keys.join(counts.where(F.col("n") > COMMON).select("suffix", F.lit(True).alias("common")), "suffix", "left")
    plain = marked.where("common is null").select("id", F.col("suffix").alias("key"))
    often = people.join(marked.where("common").select("id").distinct(), "id", "left_semi")
    blocks = plain.unionByName(often.select("id", F.explode(slip_keys("words")).alias("key"))).distinct()
    other = blocks.select("key", F.col("id").alias("b"))
    return blocks.select("key", F.col("id").alias("a")).join(other, "key").where("a < b").select("a", "b").distinct()


def slip_links(people: DataFrame, keep: Scratch) -> DataFrame:
    """(id, parent): for each identity (id, words, forms, n) the closest commoner one that differs by a slip.

    An identity written in more than ESTABLISHED forms is no slip of another.
    """
    pairs = blocked_pairs(people)
    facts = people.select("id", "words", F.struct("forms", "n").alias("weight"))
    both = pairs.join(facts.select(F.col("id").alias("a"), F.col("words").alias("wa"), F.col("weight").alias("na")), "a").join(
        facts.select(F.col("id").alias("b"), F.col("words").alias("wb"), F.col("weight").alias("nb")), "b")

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([slip(list(x), list(y)) for x, y in zip(a, b)], dtype=float)

    scored = both.withColumn("ratio", ratio("wa", "wb")).where("ratio > 0")
    up = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    rare, much = F.when(up, F.col("nb")).otherwise(F.col("na")), F.when(up, F.col("na")).otherwise(F.col("nb"))
    links = scored.select(F.when(up, F.col("b")).otherwise(F.col("a")).alias("id"), F.when(up, F.col("a")).otherwise(F.col("b")).alias("parent"), "ratio", rare.alias("rare"), much.alias("much"))
    links = links.where(F.col("rare.forms") <= ESTABLISHED)
    best = F.max_by("parent", F.struct("much", "ratio", F.hash("parent")))
    return keep.keep(links.groupBy("id").agg(best.alias("parent")))


def name_groups(mentions: DataFrame) -> DataFrame:
    """(kind, name, group) for every distinct spelling; spellings that link to nothing are groups of their own.

    Null texts, types or other columns are tolerated, repeated rows only raise counts, an empty table gives no rows.
    """
    spark = mentions.sparkSession
    keep = scratch(spark, "names")
    names = keep.keep(spellings(mentions).withColumn("id", F.concat_ws(" ", F.lower("kind"), F.array_join("words", " "))))
    full = names.where((F.size("words") >= 2) | (F.col("kind") == "ORG"))
    people = keep.keep(full.groupBy("id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"), F.first("words").alias("words"), F.first("kind").alias("kind")))
    links = slip_links(people, keep)
    while True:  # chains of slips are short; each round halves them
        jumped = links.alias("l").join(links.alias("r"), F.col("l.parent") == F.col("r.id"), "left").select("l.id", F.coalesce("r.parent", "l.parent").alias("parent"), F.col("r.id").isNotNull().alias("moved"))
        jumped = keep.keep(jumped)
        moved = jumped.where("moved").isEmpty()
        links = jumped.select("id", "parent")
        if moved:
            break
    roots = people.join(links, "id", "left").select("id", "kind", "words", F.coalesce("parent", "id").alias("group"))
    roots = keep.keep(roots)
    # Spellings with initials only: (surname, initials) fits an identity that has the surname and another word beginning so.
    part = names.where((F.size("words") == 1) & (F.col("kind") == "PERSON") & (F.length("initials") > 0)).select("name", F.col("words")[0].alias("surname"), F.substring("initials", 1, 1).alias("first"), F.substring("initials", 2, 1).alias("middle"))
    words = roots.where("kind = 'PERSON' and size(words) = 2").select("group", F.posexplode("words").alias("at", "surname"), F.col("words"))
    words = words.select("group", "surname", F.substring(F.element_at("words", 2 - F.col("at")), 1, 1).alias("first")).distinct()
    middles = full.where("kind = 'PERSON' and length(initials) = 1").join(roots.select("id", "group"), "id").groupBy("group").agg(F.collect_set("initials").alias("middles"))
    fits = part.join(words, ["surname", "first"]).join(middles, "group", "left")
    score = F.when((F.col("middle") != "") & F.array_contains("middles", F.col("middle")), 2).when((F.col("middle") != "") & (F.size("middles") > 0), 0).otherwise(1)
    fits = fits.withColumn("score", score)
    best = Window.partitionBy("name")
    fits = fits.withColumn("top", F.max("score").over(best)).where("score = top and score > 0").groupBy("name").agg(F.count(F.lit(1)).alias("ways"), F.min("group").alias("group")).where("ways = 1")
    # A firm's name that lacks one word joins the only longer name it is part of.
    longer = roots.where("kind = 'ORG' and size(words) = 3").select("group", F.explode(F.expr("transform(words, w -> concat('org ', array_join(array_remove(words, w), ' ')))")).alias("id"))
    lacking = longer.groupBy("id").agg(F.min("group").alias("whole"), F.countDistinct("group").alias("ways")).where("ways = 1")
    roots = roots.join(lacking, "id", "left").select("id", "kind", "words", F.coalesce("whole", "group").alias("group"))
    placed = full.join(roots.select("id", "group"), "id").select("kind", "name", "group")
    loose = names.join(full.select("kind", "name"), ["kind", "name"], "left_anti").join(fits.select("name", F.col("group").alias("fit")), "name", "left")
    same = F.concat_ws(" ", F.lit("part"), "id", "initials")
    loose = loose.select("kind", "name", F.coalesce("fit", same).alias("group"))
    return placed.unionByName(loose)


def variant_pairs(groups: DataFrame) -> DataFrame:
    """Distinct pairs (name_1 < name_2 by code point) of spellings in one group."""
    named = groups.select("group", "name").distinct()
    return named.select("group", F.col("name").alias("name_1")).join(named.select("group", F.col("name").alias("name_2")), "group").where("name_1 < name_2").select("name_1", "name_2").distinct()
