"""Finding personal information in free text and putting typed placeholders in its place.

Text is cut into tokens, where shapes that may be a mail address or a number of some kind are one token. A linear-chain conditional random
field over word shapes, endings, word lists and neighbours gives every token a kind; it is trained on a small labelled table composed from
patterns and decoded by Viterbi in numpy batches.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstack.llm.crf import Chain, batches, padded
from quillstack.llm.names import NICK, folded

#: Labelled sequences the model is trained on, the tokens of the longest, and rounds of training.
EXAMPLES, LONGEST, ROUNDS = 4500, 40, 45
#: Share of words that are shown to training by their shape and lists alone, as words never seen.
STRANGE = 0.25
KINDS = ["O", "NAME", "EMAIL", "PHONE", "ID_NUMBER", "ADDRESS"]
NAME, ADDRESS = 1, 5

# Given names, street words, units, state codes, words of firms, places' second words, months and days.
GIVEN = frozenset("""aaron abigail adam adrian agnes ahmed aisha albert alexander alice amanda amelia amina amir amy ana anais andrea andrew angela anita anna anthony antonio arthur ayesha barbara beatrice benjamin boris brandon brian carla carlos carmen caroline
catherine charles charlotte chen christine christopher claire clara colin cynthia daniel david deborah delphine dennis diana diego dmitri dorothy edward elena eleanor elizabeth emily emma eric esther ethan eva ewan farid fatima felix fernando fiona frances francisco frank frederick
gabriel george gerald grace gregory greta gwendolyn hannah hans harold hassan heather helen henry hiroshi hugo ian imani ingrid irene isaac isabella ivan jack jacob james jane jasmine jennifer jeremy jessica joan john jonathan jorge jose joseph joshua juan judith julia karen karl katherine
keith kenji kenneth kevin kofi lars laura lawrence leila leonard linda lorna louise lucia luis luke magnus margaret maria marie marco mark martin mary matthew maya mei michael miguel mohammed monica nadia naomi natalie nathan nicholas nina noah nora olga oliver omar pablo pamela patricia paul pedro peter
philip priya quentin rachel rafael rania raymond rebecca richard robert rosa ruth samuel sandra sara sarah sean sofia stella stephanie stephen steven susan sven tatiana theodore thomas timothy tomasz ursula uwe valerie vera victor victoria vincent virginia walter wanda wei william xenia yasmin yolanda yusuf zachary zoe""".split())
STREET = "street st avenue ave road rd boulevard blvd lane ln drive dr court ct place pl way terrace ter circle cir square sq highway hwy parkway pkwy trail row close walk mews crescent".split()
UNIT = "apt apartment suite ste unit floor fl room no".split()
STATES = "AL AK AZ AR CA CO CT DE FL GA HI IA ID IL IN KS KY LA MA MD ME MI MN MO MS MT NC ND NE NH NJ NM NV NY OH OK OR PA RI SC SD TN TX UT VA VT WA WI WV WY".split()
FIRM = """inc llc llp pllc corp corporation company co ltd incorporated realty group grp management mgmt property insurance ins agency law offices ofcs medical associates assoc construction constr brothers bros engineering engrg consultants
environmental envtl testing plumbing heating htg roofing services svcs title escrow financial holdings residential partners ptnrs""".split()
PLACE = "bend springs point heights falls ridge port lake saint old new north south east west grove county city hills park bay valley".split()
DATES = "january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun".split()
_NICKS = frozenset(p.split()[0] for p in NICK.replace("\n", " ").split(";"))

# Forms of numbers. S stands for a blank or a line end with quotation marks.
_S = r"(?:[  ~]|[ \t]*\r?\n[>|: \t]*)"
NUMBER_FORMS = [
    r"\+\d{1,3}\(\d{2,4}\)\d{6,8}", r"\+1S\d{3}S\d{3}S\d{4}", r"\+\d{2}S\d{4}S\d{6}", r"\+\d{2}S\d{2,3}S\d{4,5}S\d{3,4}", r"\+\d{1,3}(?:[ .-]\d{2,4}){2,4}", r"0\d{4}S\d{3}S\d{3}", r"\(\d{3}\)S?\d{3}[-. ]\d{4}",
    r"\d-\d{3}-\d{3}-\d{4}", r"\d{4}S\d{3,4}S\d{4}", r"\d{4}-\d{3}-\d{3,4}", r"\d{3}[.-]\d{3}[.-]\d{4}", r"\d{3}S\d{3}S\d{4}", r"\d{3}/\d{3}S\d\d-\d\d", r"\d{3}-\d{2}-\d{4}", r"\d{3}S\d{2}S\d{4}",
    r"[A-Z]\d{3}-\d{3}-\d{2}-\d{3}-\d", r"[A-Z]{2}S\d{2}S\d{2}S\d{2}S[A-Z]\b", r"[A-Z]{2}\d{6}[A-D]\b", r"[A-Z]\d{8}", r"\d{8}[A-Z]\b", r"\d{4}-[A-Z]{2}-\d{4,8}", r"[A-Z]{2,5}\d{5,}", r"\d{4}-\d{2}-\d{2}", r"\d{1,2}[./]\d{1,2}[./]\d{4}",
    r"\d{2}-\d{3}-\d{2}", r"\d{4,5}-\d{2}", r"\d{3}-\d{4}",
]
_AT = rf"{_S}?[\[(]{_S}?at{_S}?[\])]{_S}?"
_DOT = rf"{_S}?(?:[\[(]{_S}?dot{_S}?[\])]|\.){_S}?"
_MAIL = (
    r"[\w][\w.+'-]*@[\w-]+(?:\.[\w-]+)+"
    rf"|[\w][\w.+-]+{_AT}[\w-]+(?:{_S}?[\[(]{_S}?dot{_S}?[\])]{_S}?[\w-]+|\.[\w-]+)+"
    rf"|[\w][\w.+-]+{_S}at{_S}[\w-]+{_S}dot{_S}[A-Za-z]{{2,}}"
)
_NUM = "|".join(f.replace("S", _S) if "S" in f else f for f in NUMBER_FORMS)
_ABBR = "|".join(sorted({w.capitalize() for w in ["st", "rd", "ave", "blvd", "ln", "dr", "ct", "pl", "ter", "apt", "ste", "hwy", "sq", "cir", "pkwy", "no"]}, key=len, reverse=True))
_LOW = r"[a-zß-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_REST = (
    rf"(?P<abbr>(?:{_ABBR}|Esq|Jr|Sr|Mr|Mrs|Ms|Dr|Inc|Co|Corp|Ltd)\.)|(?P<init>(?:[A-ZÀ-Þ]\.){{1,3}}(?![\w]))"
    r"|(?P<unit>#?\d+[A-Za-zº][A-Za-z]?\b|#\d+)|(?P<digits>[$€£]?\d+(?:[.,:/]\d+)*%?)|(?P<word>[^\W\d_]+(?:['’-][^\W\d_]+)*)|(?P<line>[ \t]*\r?\n[>|: \t]*)|(?P<sign>[^\s\w]|_+)")
_NUMS = rf"(?P<num>(?<![\w.-])(?:{_NUM})(?!\d|[.-]\d|\w))|"
#: Patterns of tokens for stretches that hold neither mail addresses nor digits, no addresses, no digits, or both; all give the same tokens.
TOKENS = {
    (False, False): re.compile(f"(?P<low>{_LOW})|{_REST}"), (False, True): re.compile(f"(?P<low>{_LOW})|{_NUMS}{_REST}"),
    (True, False): re.compile(f"(?P<mail>{_MAIL})|{_REST}"), (True, True): re.compile(f"(?P<mail>{_MAIL})|{_NUMS}{_REST}"),
}
_MAYBE_MAIL = re.compile(rf"@|[\[(]{_S}?at{_S}?[\])]|\bat{_S}[\w-]+{_S}dot\b")
_DIGIT = re.compile(r"\d")
_BLANK = re.compile(r"\n(?:[>|: \t\r]*\n)+")


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    at = 0
    for m in _BLANK.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def tokens(text: str, lo: int = 0, hi: int | None = None) -> list[tuple[str, str, int, int]]:
    """(group, text, start, end)."""
    hi = len(text) if hi is None else hi
    pattern = TOKENS[_MAYBE_MAIL.search(text, lo, hi) is not None, _DIGIT.search(text, lo, hi) is not None]
    return [("word" if m.lastgroup == "low" else m.lastgroup, m[0], *m.span()) for m in pattern.finditer(text, lo, hi)]


def word_shape(w: str) -> str:
    if w.isupper():
        return "X" if len(w) == 1 else "XX"
    if w.islower():
        return "x"
    return "Xx" if w[0].isupper() and w[1:].islower() else "mixed"


_STREETS, _UNITS, _STATES, _FIRMS, _PLACES, _DATES = map(frozenset, (STREET, UNIT, STATES, FIRM, PLACE, DATES))


def token_features(group: str, w: str) -> list[str]:
    """What a token looks like; the same token always looks the same."""
    if group == "line":
        return ["line"]
    if group == "mail":
        return ["bias", "mail", "mail" + ("@" if "@" in w else "at"), "mail" + word_shape(w) if w[0].isalpha() else "mail9"]
    if group == "num":
        signs = "".join(sorted({c for c in w if c in "+()-./"}))
        letters = re.sub(r"[^A-Z9]", "", re.sub(r"\d+", "9", w))
        return ["bias", "num", "signs=" + signs, "lead=" + ("A" if w[0].isalpha() else "0" if w[0] == "0" else "9" if w[0].isdigit() else w[0]), "letters=" + letters[:3] + letters[-1:], f"digits{sum(c.isdigit() for c in w)}", "form=" + re.sub(r"\d", "9", re.sub(r"[A-Z]", "A", re.sub(r"\s+[>|: \t]*|[ ~]", " ", w)))]
    if group in ("digits", "unit"):
        s = re.sub(r"\d", "9", w)
        return ["bias", group, "form=" + s, f"n{len(w)}"]
    if group == "sign":
        return ["sign=" + w[0]]
    if group == "init":
        return ["bias", "init", f"init{min(len(w), 4)}"]
    low = folded(w).rstrip(".")
    out = ["bias", "shape=" + word_shape(w.rstrip(".")), "w=" + low, "s3=" + low[-3:], "s2=" + low[-2:], f"len{min(len(low), 10)}"]
    if group == "abbr":
        out.append("abbr")
    bare = low.split("'")[0]
    if bare in GIVEN:
        out += ["given", "given" + word_shape(w)]
    elif bare in _NICKS:
        out += ["nick", "nick" + word_shape(w)]
    elif len(low) > 5 and len(re.findall("[aeiouy]+", low)) >= 3:
        out.append("long_name_like" + word_shape(w))
    if low in _STREETS:
        out.append("street")
    if low in _UNITS:
        out.append("unit_word")
    if w in _STATES:
        out.append("state")
    if low in _FIRMS:
        out.append("firm")
    if low in _PLACES:
        out.append("place")
    if low in _DATES:
        out.append("date")
    return out


# --- The labelled table ---
def made_word(rng: random.Random, ends: list[str]) -> str:
    return "".join(rng.choice("bdfghjklmnprstvwyz") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))).capitalize() + rng.choice(ends)


SURNAME_ENDS = """son sen man mann berg stein field ford ton ham ley worth wood well shaw land ing er ez es ini elli otti ov ova ev ski sky wicz vich ic ko enko chuk yan ian as is ou idis
quist strom lund gren dahl feld bach meier hoff rath kamp beck low more ridge side stone smith wright monger gate house bridge bank ling ow ck nd rd st""".split()
PLACE_ENDS = "ton ham ville burg bury ford mouth dale wood field port stead worth haven minster chester mere brook".split()
FIRM_HEADS = "Blue Red Green Golden Iron Granite River Ocean Harbor Eagle Lion Crown Liberty Pioneer Premier United Central National Pacific Northern Eastern Prime Royal Bright Clear High Long".split()
STEM_ENDS = "ton star line field gate point way bridge crest view mark peak stone land light wood".split()
TRADES = "Realty Insurance Law Medical Construction Engineering Environmental Plumbing Roofing Title Financial Property Residential Dental Design Software Security Logistics Foods Energy Steel Paper Motor Travel Media Care Electric Marine Testing Heating Escrow Ins. Constr. Envtl. Engrg Htg Prop. Fin'l".split()
FORMS = "Group Agency Offices Associates Partners Services Holdings Consultants Management Company Works Systems Brothers Solutions Bank Trust Institute Foundation Studio Labs Grp Svcs Mgmt Assoc. Bros. Ofcs.".split()
STREETS = "Maple Oak Elm Cedar Pine Church Station Park Mill High Lincoln Spring Meadow Chestnut Walnut Lake Hill Forest River Orchard Garden Chapel Sunset Willow Franklin Jackson Market Water Cherry Ridge Highland Victoria Queens Bridge".split()
GIVEN_LIST, NICK_LIST = sorted(GIVEN), sorted(_NICKS)
# The labelled table: letters in braces stand for items and fillers, ¶ for a line end.
PATTERNS = """Hello {F}|Hi {F}|Good morning {F}|Morning {F}|Hello {F}¶{W} {w} {w}.|Hi {F}¶The {w} is {w}.|Hola {F}¶{w} {w}|Dear {F},|Hi {F},|Hello {F}|Hello {F},|Hey {F}!|Good evening {F},|Hola {F},|{F},|{F} -|Bonjour {F},|Liebe {F},|Lieber {F},|Estimada {F}:|Dear Mr. {L}:|Dear Ms. {L},|Hi {F} and {F},|{C},¶{F}|{C},¶{N}|{C}¶{N}¶{J}|{C},¶{N}¶{J}¶{O}¶{T} {P}¶{M}¶{A}|{C},¶{N}¶{O}¶{P}¶{M}|{C},¶¶{N}¶{M}¶{A}|--¶{N}¶{J}, {O}¶{T} {P}|--¶{N}¶{P}¶{A}|--¶{N}¶{J}¶{O}¶{M}|--¶{N}¶{A}|{N}¶{J}¶{T} {P}¶{A}
{N} <{M}>|"{N}" <{M}>|{M} ({N})|{M}|{R} <{M}>|"{R}" <{M}>|{V} <{M}>|support@{w}.example|{M} ({R})|{N}, Esq. <{M}>|{O} <{M}>
On {D}, {N} <{M}> wrote:|On {D}, {N} <{M}>¶wrote:|{N} <{M}> wrote on {d} {t}:|Am {d} {t} schrieb {N}:|El {d} {t}, {N} escribió:|Le {d} {t}, {N} a écrit :|*From:* {N}¶*Sent:* {E} {t}¶*Subject:* {S}|From: {N} <{M}>¶Sent: {E} {t}¶To: {N}¶Subject: RE: {S}|From: {N}¶Date: {E} {t}¶Subject: {S}|To: {N}¶Subject: {O}|To: {N}; {N}¶Cc: {R}¶Date: {E}
{R} {w} the {w}.|{R} has left {O}.|because {R} {w} {w}|{R} {w}.|{W} {R} {w} the {w}|{R},¶{P}|when {R} {w} from {A}|{N} {w} from {A}|{B} {R} about {w}.|{B} {N} about {w}.|{B} {R}, {P}, {w}.|{B} {N}, {P}, {w}.|{B} {M} {w}.|{B} {N} {w} {w}.|{N} will dial in from {G}.|I spoke with {N} this morning about the {w}.|According to {N}, the {w} came late.|{N} has been silent since {e}.|Could you loop in {N} before the {w} goes out?|{N} took the minutes and {N} chaired.|Everyone but {N} was there when we opened the {w}.|{N} is employed by {O}.|{N} of {O} phoned twice.|{O} named {N} as its contact.|{R} is entered as the owner.|Witnesses: {R}; {R}; {N}.|Please welcome {N}, {J}.|This draft comes from {N} at {O}.|{N}, our {u}, does not agree.|Signed: {N}|Present: {N}, {N} and {N}|{N} or {N} can sign for it.|{W}, {N} had already left.|{W} {N} had the {w}.|{W} I told {N} that the {w} {w}.|{N}'s {w} is ready.|I gave {F}'s {w} to {F}.|{F} knows more about the {w}.|Tell {F} that the {w} is here.|{F} and {F} share the {u}.|{F},¶{W} the {w} was {w}.|{F},¶{N} left the {w}.|{F},¶the {w} is {w}.|In {G} we met {N}, {N} and¶{N}.|{N} saw it; {R} did not.|{R} and {N} owe {O} ${k}.|{N}, Esq., filed the {w}.|{N} wins against {O}.|{N} paid ${k} on {e}.|a letter from {R}, dated {e}, about {w}|on behalf of {N}|{w} {N} {w}
{N} answers on {P}.|Dial {P} and ask for {N}.|{T} {P}|Our switchboard is {P}; fax {P}.|Text {P} when you get there.|{P} is the quickest way to {N}.|In an emergency: {N}, {P}|Either {P} or {P} will do.|{N} was on the line ({P}).|{N}, {P}, keeps the {w}.|{R}, {P}, keeps the {w}.|{W}, use {P} from now on.|the desk ({P}) or {M}|{w} {P}, {w}|{w} {P} {w}|{w} {P}|{w} {w} {P} {w} {w}|at¶{P} {w}
Write to {M} for the {w}.|The {w} went to {M} and to {M}.|{M} bounced; {M} works.|Her address is {M}.|{N} ({M}) keeps the {w}.|{R} ({M}) keeps the {w}.|{N}¶({M}) has {w}.|Contact: {M}|Questions go to {M} or {P}.|{w} {M} {w}|Does {N} still read {M}?
{N}'s {K} is {I}.|Her {K}: {I}|We need a copy of {K} {I} from {N}.|{I} is what we hold for {N}.|Claimant {N}, {K} {I}, born {e}.|Payroll keeps {I} under {N}.|The {w} shows {I}.|Kindly strike {K} {I} from the {w}.|Whose {w} is {I}?|{w} {K} {I} {w}|{K} {I}; {w}|{K} {I} for {N}, {w}|{K} {I} for {R},¶{w}|{I}|{w} {I} {w}|{w} {w} {K} {I} {w} {w}|{K} {I} {w} {N}|{W} {K} {I} {w}
We visited {A} on {e}.|{A} was sold to {N}.|{N} rents {A}.|{N} rents {A} and {w}.|The {w} belongs at {A}.|Ship everything to {A}, attention {N}.|Ship everything to¶{A}.|Our new office: {A}|Home: {A}|He gave up {A} in {e}.|The {u} in {A} is {w}.|{N}, {A}|{N}, {A}, {P}|{N}, Esq., {A}, {P}|{N}¶{A}|{A}¶{P}|They went from {A} to {A}.|Premises: {A}.|{N} stayed at {A}; {N} came later ({P}).|at {A} and¶{w}|the ${k} for {N},¶{A}|{w} {A} {w}|{R} owns {A}.|The {w} at {A} has {w}.
{N} llegará mañana.|Hablé con {N} ayer.|Escriba a {M}.|Mi teléfono es {P}.|Vivo en {A}.|{N} trabaja en¶{A}.|Su {K} es {I}.|mi documento {K} {I}|{N} pagó ${k} el {e}.|Pregunte por {N} en el {P}.|{R} no ha venido.|{N} ne sera pas là.|J'ai vu {N} hier.|Appelez {N} au {P}.|Il habite {A}.|{N} wohnt in {A}.|Bitte rufen Sie {N} unter {P} an.|Ich habe mit {N} gesprochen.|Schreiben Sie an {M}.|El {w} de {G} cierra el {e}.|{O} no respondió.|La {w} está en {G}.|Der Termin in {G} ist am {e}.
{w} {e} {w}|{w} {w} {e}.|{w}.¶{C},¶{F}|{C},¶{F}¶{w}|{C},¶{F}|{w} in {G} {w} {w}.|in¶{G} {w}|{w} in¶{G} {w} {w}, {w}|the {w} {X}|{w} {X}.|{W} {X} {w}|¶{X} {w}|{w} {w} {X} {w}|{w} {w} {e}; {w}|since {e} and until {e}|on¶{e}.|before {e}.|by {e}, {w}|the {u} on {e} {w}|dated¶{e}, {w}|{w} from {e} to {e}|{w} {w} {w} {w}|the {w} for {w} {w} and the {w} {w}|{w}, {w} {w}|Our reference is {X}.|Order {X} has left {G}.|Ref: {X} / {X}|Docket {X} is closed.|Policy {X} ran out on {e}.|Container {X} sits in {G}.|Serial {X}|Parcel {X} came today.|Bill {X} of {e} is open.|see pages {x} to {x}|clause {x}.{x}({y})|Release {y}.{x}.{y}|Lots {X} to {X} are sold.|{w} {X} {w}|Track it under {X}.|Counter: {X}|Room {x}, {G}|Page {y} of {x}|{x}-{x} {w}
The mayor of {G} was {w}.|{O} offered ${k}.|{O} and {O} made peace.|{G} is shut on Monday.|{O} runs a {u} in {G}.|Exhibit {x} is {w}.|The Council of {G} met on {e}.|{W}, the {w} was {w}.|{W} the {w} {w}, and the {w} {w}.|{W} nobody {w} the {w} in {G}.|{O}¶has the {w}.|We asked {O} for the {w} of {G}.|Subject: {S}|{W} {w} {w} {w}.|{W} a {w} from {O} {w}.|Between {e} and {e} the {u} was shut.|It cost ${k}, then ${k}.|{W} {x} {w} were {w}.|A Judge of the Court said so.|North of {G} there is a {u}.|From: where we stand, it is {w}.|To: whom it may concern|{C} to all of them.|NOTICE: this {u} is {w}.|{w}, {w}; {w}: {w}.|The {W} of {O} is {w}."""
WORDS = """water report garden bridge letter machine market coffee bicycle window ticket number paper story engine winter summer music picture table season village river doctor teacher driver student customer worker owner seller buyer judge nurse author
contract invoice payment parcel package schedule budget meeting agenda minutes proposal sample warranty licence permit deposit refund signature photograph sketch ledger deed claim filing hearing notice inspection lease roof basement kitchen elevator parking heating
broken missing late early final open closed wet dry heavy quiet careful cheap urgent possible likely useful correct wrong signed copied printed delayed repaired painted cleaned moved lost found sold checked counted measured because while after before although unless until""".split()
ORDERS = "Ask Call Email Tell Remind Invite Pay Thank Meet Phone Copy Include Notify Contact Help Follow Bring Warn".split()
JOBS = "Senior Junior Chief Claims Sales Office Property Leasing Legal Case Technical Deputy Regional".split(), "Engineer Manager Assistant Adjuster Agent Administrator Partner Counsel Officer Analyst Paralegal Associate Director Accountant".split()
STARTS = "However Yesterday Today Perhaps Meanwhile Unfortunately Luckily Apparently Therefore Still Instead Later Earlier Sometimes Usually Finally Also Besides Once If When Because While After Before Although Unless Since We They Our Their My Please Thanks No Yes Both Several Every Each Another Some This That These There Here What Who How Nobody Somebody Everybody Photos Documents Number Judge Court Clerk".split()


class Composer:
    """Draws labelled token sequences from the patterns."""

    def __init__(self, seed: int = 3):
        self.rng = random.Random(seed)
        rng = self.rng
        self.places = [made_word(rng, PLACE_ENDS) for _ in range(16)] + [f"{made_word(rng, PLACE_ENDS)} {w}" for w in "Bend Springs Point Heights Falls Ridge Grove Hills Park Bay Valley City".split()]
        self.places += [f"{w} {made_word(rng, PLACE_ENDS)}" for w in "Port Lake Saint Old New Fort North South East West".split()]

    def surname(self) -> str:
        return made_word(self.rng, SURNAME_ENDS)

    def given(self) -> str:
        r = self.rng
        w = r.choice(GIVEN_LIST if r.random() < 0.7 else NICK_LIST).capitalize()
        if r.random() < 0.08:  # names nobody listed, and slips
            w = made_word(r, ["a", "o", "n", "s", ""])
        elif r.random() < 0.08 and len(w) > 4:
            k = r.randint(1, len(w) - 2)
            w = r.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k] + w[k:], w[:k] + w[k + 1 :]])
        return w

    def name(self) -> str:
        r, f, s = self.rng, self.given(), self.surname()
        x = r.random()
        i = r.choice("ABCDEFGHJKLMNPRSTW") + "."
        if x < 0.45:
            return f"{f} {s}"
        return r.choice([f"{f} {i} {s}", f"{f[0]}. {s}", f"{f[0]}.{i} {s}", f"{f}  {s}", f"{f.lower()} {s.lower()}", f"{f.upper()} {s.upper()}", f"{f} {s}, Esq.", f"{f} {s}, Esq.", f"{s} {f}", f"{f}¶{s}", f"{f} {i}¶{s}", f"{f.lower()} {s.lower()}", f"{f.lower()}¶{s.lower()}", f"{s}, {f}", f"{s}, {f[0]}."])

    def reversed(self) -> str:
        r, f, s = self.rng, self.given(), self.surname()
        i = r.choice("ABCDEFGHJKLMNPRSTW") + "."
        return r.choice([f"{s}, {f}", f"{s.upper()}, {f} {i}", f"{s}, {f[0]}.", f"{s} {f}", f"{s},¶{f}", f"{s}, {f}"])

    def firm(self) -> str:
        r = self.rng
        stem = r.choice(FIRM_HEADS) + r.choice(["", " ", "ra", "o", "ix", "ve"]) + r.choice(STEM_ENDS)
        if r.random() < 0.35:
            stem = made_word(r, STEM_ENDS)
        trade = f"{r.choice(TRADES)} {r.choice(['', '', '', '& ', 'and '])}{r.choice(FORMS)}"
        if r.random() < 0.1:
            trade = f"{r.choice(TRADES)} & {r.choice(TRADES)}"
        tail = r.choice(["", "", " LLC", " Inc.", " Corp.", " PLLC", " LLP", " Company", ", Co.", ", L.L.C.", ", Corporation", " P.L.L.C.", ", Inc", " Llc", " Incorporated"])
        x = r.choice([f"{stem} {trade}{tail}", f"{stem} {trade}{tail}", f"{stem} {trade}{tail}", f"The {stem} {trade}{tail}", f"{trade} - {stem}", f"{stem}-{trade}", f"{stem.lower()} {trade.lower()}", f"{stem.upper()} {trade.upper()}{tail.upper()}", f"{stem}  {trade}"])
        return x

    def mail(self) -> str:
        r = self.rng
        user = r.choice([f"{self.given().lower()}.{self.surname().lower()}", f"{self.surname().lower()}{r.randint(1, 999)}", f"{self.given().lower()}_x", "office", "billing", "no-reply"]) + r.choice(["", "", "+legal"])
        host, top = made_word(r, PLACE_ENDS).lower() + r.choice(["law", "mail", "-net", "-home"]), r.choice(["example", "test", "invalid", "com", "org"])
        return r.choice([f"{user}@{host}.{top}"] * 6 + [f"{user}@{host}.{top}".upper(), f"{user} [at] {host} [dot] {top}", f"{user}(at){host}.{top}", f"{user} at {host} dot {top}"])

    def digits(self, form: str) -> str:
        return "".join(str(self.rng.randint(0, 9)) if c == "9" else c for c in form)

    def phone(self) -> str:
        return self.digits(self.rng.choice(["(999) 999-9999", "999-999-9999", "999.999.9999", "999 999 9999", "999 999 9999", "+1 999 999 9999", "+1(999)9999999", "9-999-999-9999", "9999999999", "999-9999", "999/999 99-99", "+99 99 99999 999", "+44 9999 999999", "07999 999 999", "+99 999 9999 9999", "+33 9 99 99 99 99"]))

    def number(self) -> tuple[str, str]:
        """(label, identity number)."""
        label, form = self.rng.choice([("SSN", "999-99-9999"), ("SS#", "999999999"), ("social", "999 99 9999"), ("", "999-99-9999"), ("NI number", "QQ 99 99 99 C"), ("DNI", "99999999T"), ("passport", "X99999999"), ("driver license", "D999-999-99-999-9"), ("NI number", "AB 99 99 99 D"), ("", "999 99 9999"), ("SS#", "999999999"), ("NI¶number", "QQ 99 99 99¶C")])
        return label, self.digits(form)

    def other_number(self) -> str:
        return self.digits(self.rng.choice(["9999 9999 9999", "9999 999 9999", "9999-999-9999", "9999-999-999", "99-999-99", "99999-99", "9999-99", "TRL999999", "9999-CA-999999", "9999-DR-999999", "BRW9999999", "9999-SC-999999"]))

    def address(self) -> str:
        r = self.rng
        n, w = r.choice([r.randint(1, 199), r.randint(1000, 9999)]), r.choice(STREETS) if r.random() < 0.6 else made_word(r, ["", "ley", "side", "stone", "wood", "box", "mere"])
        unit = r.choice([f"Apt {r.randint(1, 60)}B", f"Suite {r.randint(1, 60)}A", f"Unit {r.randint(1, 60)}C", f"Apt. {r.randint(1, 60)}", f"Suite {r.randint(100, 900)}"])
        state = f"{r.choice(STATES)} {r.randint(0, 99999):05d}"
        kind = r.random()
        if kind < 0.72:
            street = r.choice(["Street", "St.", "Avenue", "Ave", "Ave.", "Road", "Rd.", "Rd", "Boulevard", "Blvd", "Blvd.", "Lane", "Ln", "Ln.", "Drive", "Dr.", "Court", "Ct", "Place", "Way", "Terrace", "Pl."])
            out = f"{n} {w} {street}"
            if r.random() < 0.15:
                out += f" #{r.randint(1, 40)}B"
            elif r.random() < 0.35:
                out += f", {unit}"
            if r.random() < 0.55:
                out += f", {r.choice(self.places)}, {state}"
        else:
            out = r.choice([f"{n} rue {w}", f"Calle {w} {n}, {r.randint(1, 9)}º{r.choice('ABCD')}", f"Calle {w} {n}", f"{w}weg {n}, {r.randint(0, 99999):05d} {r.choice(self.places)}", f"{w}straße {n}, {r.randint(0, 99999):05d} {r.choice(self.places)}", f"{w}weg {n}"])
        if r.random() < 0.2:
            cuts = [k for k, c in enumerate(out) if c == " "]
            k = r.choice(cuts)
            out = out[:k] + "¶" + out[k + 1 :]
        return out

    def fill(self, code: str) -> tuple[str, str]:
        r = self.rng
        if code == "F":
            return r.choice([self.given, self.given, self.given, self.given, self.given])(), "NAME"
        if code == "L":
            return self.surname(), "NAME"
        if code == "N":
            return self.name(), "NAME"
        if code in "RV":
            return self.reversed(), "NAME"
        if code == "M":
            return self.mail(), "EMAIL"
        if code == "P":
            return self.phone(), "PHONE"
        if code == "A":
            return self.address(), "ADDRESS"
        if code == "O":
            return self.firm(), "O"
        month, day, year = r.choice("January February March April May June July August September October November December Jan Feb Mar Apr Jun Jul Aug Sep Oct Nov Dec".split()), r.randint(1, 28), r.randint(1998, 2029)
        date = r.choice([f"{r.randint(1, 12)}/{day}/{year}", f"{year}-{r.randint(1, 12):02d}-{day:02d}", f"{month} {day}, {year}", f"{day} {month} {year}", f"{day}.{r.randint(1, 12)}.{year}", f"{r.randint(1, 12):02d}/{day:02d}/{year}"])
        return {
            "W": lambda: r.choice(STARTS), "B": lambda: r.choice(ORDERS), "X": self.other_number, "G": lambda: r.choice(self.places), "w": lambda: " ".join(r.choice(WORDS) for _ in range(r.randint(1, 2))), "u": lambda: r.choice(WORDS), "k": lambda: f"{r.randint(1, 50)},{r.randint(100, 999)}", "x": lambda: str(r.randint(10, 99)), "y": lambda: str(r.randint(1, 9)),
            "e": lambda: date, "E": lambda: date, "S": lambda: f"{r.choice(['Your', 'About the', 'Re:', 'New', 'Reminder:'])} {r.choice(WORDS)}", "d": lambda: f"{r.randint(1, 28)}.0{r.randint(1, 9)}.202{r.randint(0, 5)}", "t": lambda: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}",
            "D": lambda: f"{r.choice(['Mon', 'Tue', 'Wed', 'Fri'])}, {r.choice(['Sep', 'Feb', 'Mar', 'Oct'])} {r.randint(1, 28)}, 202{r.randint(0, 5)} at {r.randint(1, 12)}:{r.randint(10, 59)} {r.choice(['AM', 'PM'])}", "C": lambda: r.choice(["Best", "Regards", "Thanks", "Kind regards", "Sincerely", "Cheers", "Saludos", "Talk soon", "Thank you"]),
            "J": lambda: r.choice(["", "", r.choice(JOBS[0]) + " "]) + r.choice(JOBS[1]), "T": lambda: r.choice(["Tel:", "m.", "Direct", "Phone:", "Cell:", "Fax"]),
        }[code](), "O"

    def draw(self, patterns: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        """(text, labelled spans) of one to three patterns in a row."""
        text, spans = "", []
        for k in range(self.rng.choice([1, 1, 2, 3])):
            if k:
                text += self.rng.choice([" ", "\n"])
            pending = None
            for part in re.split(r"(\{\w\})", self.rng.choice(patterns)):
                if re.fullmatch(r"\{\w\}", part):
                    if part[1] in "KI":
                        label, number = pending or self.number()
                        pending = (label, number) if part[1] == "K" else None
                        value, kind = (label, "O") if part[1] == "K" else (number, "ID_NUMBER")
                        if part[1] == "I" and not pending and self.rng.random() < 0:
                            continue
                    else:
                        value, kind = self.fill(part[1])
                    value = value.replace("¶", "\n")
                    if kind != "O" and value:
                        spans.append((len(text), len(text) + len(value), kind))
                    text += value
                else:
                    text += part.replace("¶", "\n")
        return text, spans


@lru_cache(maxsize=1)
def personal_model() -> Chain:
    """The model trained on the composed table, once per driver."""
    composer, patterns = Composer(), [p for line in PATTERNS.split("\n") for p in line.split("|")]
    patterns += [p for p in patterns if re.search(r"\{[PIX]\}", p)]  # numbers look alike: twice the examples
    memo: dict[tuple, int] = {}
    units: list[list[str]] = [[]]
    rows, gold = [], []
    for _ in range(EXAMPLES):
        text, spans = composer.draw(patterns)
        row, marks = [], []
        for group, w, lo, hi in tokens(text):
            key = (group, w, group == "word" and composer.rng.random() < STRANGE)
            if key not in memo:
                memo[key] = len(units)
                units.append([f for f in token_features(group, w) if not (key[2] and f[:2] in ("w=", "s3", "s2"))])
            row.append(memo[key])
            marks.append(next((KINDS.index(k) for a, b, k in spans if a <= lo and hi <= b), 0))
        if 0 < len(row) <= LONGEST:
            rows.append(row)
            gold.append(marks)
    # A word seen once is described by its looks alone, as unknown words will be.
    seen: dict[str, int] = {}
    for u in units:
        for f in u:
            if f.startswith("w="):
                seen[f] = seen.get(f, 0) + 1
    count: dict[int, int] = {}
    for row in rows:
        for u in row:
            count[u] = count.get(u, 0) + 1
    units = [[f for f in u if not f.startswith("w=") or count.get(k, 0) >= 4] for k, u in enumerate(units)]
    return Chain(KINDS, (-2, -1, 0, 1, 2)).fit(units, padded(rows), padded(gold), rounds=ROUNDS)


# --- Decoding ---
def completed(toks: list[tuple[str, str, int, int]], kinds: np.ndarray) -> None:
    """Addresses are carried on to their street word, unit, town, state and code."""
    home, n = KINDS.index("ADDRESS"), len(toks)
    solid = [i for i in range(n) if toks[i][0] != "line"]
    where = {i: x for x, i in enumerate(solid)}

    def at(x: int) -> tuple[str, str]:
        return (toks[solid[x]][0], toks[solid[x]][1]) if 0 <= x < len(solid) else ("", "")

    def capital(x: int) -> bool:
        return at(x)[0] == "word" and at(x)[1][0].isupper()

    def code(x: int) -> bool:
        return at(x)[0] == "digits" and len(at(x)[1]) == 5 and at(x)[1].isdigit()

    for i in solid:
        x = where[i]
        if kinds[i] != home or x + 1 < len(solid) and kinds[solid[x + 1]] == home:
            continue
        end = x
        if at(end)[0] == "word" and at(end + 1)[0] in ("word", "abbr") and folded(at(end + 1)[1]).rstrip(".") in _STREETS and at(end + 1)[1][0].isupper():
            end += 1
        if at(end + 1)[0] == "unit" and at(end + 1)[1][0] == "#" or at(end)[0] in ("word", "abbr") and folded(at(end)[1]).rstrip(".") in _UNITS and at(end - 1)[1] == "," and at(end + 1)[0] in ("unit", "digits"):
            end += 1
        if at(end + 1)[1] == "," and folded(at(end + 2)[1]).rstrip(".") in _UNITS and at(end + 3)[0] in ("unit", "digits"):
            end += 3
        for k in (1, 2):
            if at(end + 1)[1] == "," and all(capital(end + 1 + y) for y in range(1, k + 1)) and at(end + 2 + k)[1] == "," and at(end + 3 + k)[1] in _STATES and code(end + 4 + k):
                end += 4 + k
                break
        if code(end) and not at(end - 1)[1] in _STATES and at(end - 1)[1] == "," and capital(end + 1):
            end += 2 if capital(end + 2) and toks[solid[end + 2]][2] - toks[solid[end + 1]][3] <= 3 and folded(at(end + 2)[1]) in _PLACES or folded(at(end + 1)[1]) in _PLACES and capital(end + 2) else 1
        if end > x:
            kinds[i : solid[end] + 1] = home


def spans_of(text: str, toks: list[tuple[str, str, int, int]], kinds: np.ndarray) -> list[tuple[int, int, str]]:
    """Runs of tokens of one kind, trimmed to what belongs to the item."""
    out, i, n = [], 0, len(toks)
    while i < n:
        k = kinds[i]
        if k == 0:
            i += 1
            continue
        j = i
        while j < n and kinds[j] == k:
            j += 1
        kind = KINDS[k]
        if kind in ("EMAIL", "PHONE", "ID_NUMBER"):
            for t in toks[i:j]:
                if t[0] in ("mail", "num") or t[0] == "digits" and sum(c.isdigit() for c in t[1]) >= 7:
                    out.append((t[2], t[3], kind))
        else:
            a, b = i, j
            while a < b and toks[a][0] in ("line", "sign") and toks[a][1] != "#":
                a += 1
            while b > a and toks[b - 1][0] in ("line", "sign"):
                b -= 1
            if b > a:
                out += [(lo, hi, kind) for lo, hi in (split_names(toks[a:b], toks[a - 1][1].lower() if a else "") if kind == "NAME" else [(toks[a][2], toks[b - 1][3])]) if acceptable(kind, text[lo:hi])]
        i = j
    return out


def known_given(w: str) -> bool:
    low = folded(w)
    return low in GIVEN or low in _NICKS


def split_names(toks: list[tuple[str, str, int, int]], before: str) -> list[tuple[int, int]]:
    """One run of name tokens can hold several names.

    They part at signs other than , . - ', at line ends after a full name, and after a given name alone on a line with a comma. Words in
    small letters are cut off names in capitals; a single word must be a known given name or follow a salutation or title.
    """
    out, cur, n_words = [], [], 0
    for t in [*toks, ("sign", ";", 0, 0)]:
        ends = t[0] == "sign" and t[1] not in ",.-'’"
        ends |= t[0] == "line" and n_words >= 2 and cur[-1][1] != ","
        ends |= t[0] == "line" and n_words == 1 and cur[-1][1] == "," and known_given(next(x[1] for x in cur if x[0] in ("word", "init")))
        if ends:
            while len(cur) > 1 and cur[0][0] == "word" and cur[0][1].lower() in _GREETINGS and cur[1][0] != "sign":
                before = cur.pop(0)[1].lower()
            words = [x for x in cur if x[0] in ("word", "init")]
            if len(words) > 1 and any(x[1][0].isupper() for x in words):
                while cur and not (cur[-1][0] in ("init", "abbr") or cur[-1][1][0].isupper()):
                    cur.pop()
                cur = cur[next((k for k, x in enumerate(cur) if x[0] == "init" or x[1][0].isupper()), len(cur)) :]
            while cur and cur[-1][0] in ("line", "sign"):
                cur.pop()
            commas = [x for x, y in enumerate(cur) if y[1] == ","]
            if commas and cur[0][0] == "word" and not known_given(cur[0][1]) and commas[0] == 1:
                behind = [x for x in cur[2 : commas[1] if len(commas) > 1 else None] if x[0] == "word"]
                if len(behind) >= 2 or len(commas) > 1 and not cur[-1][0] == "abbr":  # an adverb before the name
                    cur = cur[2:]
                    while cur and cur[0][0] in ("line", "sign"):
                        cur.pop(0)
            words = [x for x in cur if x[0] in ("word", "init")]
            greeted = before in _GREETINGS and not out
            if len(words) > 1 or len(words) == 1 and words[0][0] == "word" and (known_given(words[0][1]) or greeted):
                out.append((cur[0][2], cur[-1][3]))
            cur, n_words = [], 0
        elif cur or t[0] not in ("line", "sign", "abbr"):
            cur.append(t)
            n_words += t[0] in ("word", "init")
    return out


_GREETINGS = frozenset("dear hi hello hola morning liebe lieber cher chère estimado estimada mr mr. mrs mrs. ms ms. dr dr. herr frau señor señora monsieur madame".split())


def mended(toks: list[tuple[str, str, int, int]], kinds: np.ndarray) -> None:
    """Names written surname first, and post-nominals, are completed."""
    n, name = len(toks), KINDS.index("NAME")
    at = [i for i, t in enumerate(toks) if t[0] != "line"]
    for x, i in enumerate(at[:-2]):
        c, g = at[x + 1], at[x + 2]
        if kinds[i] == name and c == i + 1 and kinds[c] == 0 and toks[c][0] == "word" and toks[i][0] == "word" and known_given(toks[i][1]) and word_shape(toks[c][1]) == word_shape(toks[i][1]) != "x" and len(toks[c][1]) > 4:
            if not (x and kinds[at[x - 1]] == name) and folded(toks[c][1]) not in _FIRMS | _PLACES | _DATES | _STREETS and len(re.findall("[aeiouy]+", folded(toks[c][1]))) >= 3:
                kinds[c] = name
        if toks[c][1] != "," or toks[g][0] not in ("word", "init", "abbr"):
            continue
        if kinds[i] == name and toks[g][1].rstrip(".") in ("Esq", "Jr", "Sr", "III", "II", "PhD", "MD", "JD", "CPA"):
            kinds[i + 1 : g + 1] = name
        elif toks[i][0] == "word" and toks[i][1][0].isupper() and len(toks[i][1]) > 4 and not known_given(toks[i][1]) and toks[g][0] == "word" and toks[g][1][0].isupper() and known_given(toks[g][1]):
            low = folded(toks[i][1])
            lone = x == 0 or not (toks[at[x - 1]][0] == "word" and toks[at[x - 1]][1][0].isupper() and kinds[at[x - 1]] != 0)
            if kinds[i] == name and lone and low not in _FIRMS | _PLACES | _DATES | _STREETS:
                kinds[i : g + 1] = name
                if g + 1 < n and toks[g + 1][0] == "init":
                    kinds[g + 1] = name


def acceptable(kind: str, s: str) -> bool:
    if kind == "ADDRESS":
        return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(s) > 6
    return sum(c.isalpha() for c in s) >= 2 and not any(c.isdigit() for c in s)


def find_all(texts: list[str], model: Chain) -> list[list[tuple[int, int, str]]]:
    """Items (start, end, kind) of many texts. Equal paragraphs are decoded once."""
    memo: dict[tuple, int] = {}
    units: list[list[str]] = [[]]
    rows: list[list[int]] = []
    toks: list[list] = []
    places: dict[str, int] = {}
    where: list[list[tuple[int, int]]] = []
    for text in texts:
        mine = []
        for lo, hi in paragraphs(text) if text else ():
            part = text[lo:hi]
            if part not in places:
                got = tokens(part)
                row = []
                for group, w, _, _ in got:
                    key = (group, w)
                    u = memo.get(key)
                    if u is None:
                        u = memo[key] = len(units)
                        units.append(token_features(group, w))
                    row.append(u)
                places[part] = len(rows)
                rows.append(row)
                toks.append([part, got])
            mine.append((lo, places[part]))
        where.append(mine)
    table = model.tables(*model.flat(units), len(units))
    found: list[list[tuple[int, int, str]]] = [[]] * len(rows)
    for some in batches(rows, 100_000):
        if not rows[some[-1]]:
            continue
        got = model.decode(table, padded([rows[k] for k in some]))
        for k, g in zip(some, got):
            part, ts = toks[k]
            g = g[: len(ts)].copy()
            if not g.any():
                continue
            if (g == NAME).any():
                mended(ts, g)
            if (g == ADDRESS).any():
                completed(ts, g)
            found[k] = spans_of(part, ts, g)
    return [[(lo + a, lo + b, kind) for lo, k in mine for a, b, kind in found[k]] for mine in where]


def personal_items(emails: DataFrame) -> DataFrame:
    """(id, field_name, start, end, pii_type, pii_text) in content and sender of emails (id, content, sender).

    Null and empty fields hold nothing. Repeated rows give repeated items, extra columns are ignored, an empty table gives no rows.
    Texts are worked through whole, paragraph by paragraph.
    """
    shipped = emails.sparkSession.sparkContext.broadcast(personal_model())

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for field in ("content", "sender"):
                texts = part[field].tolist()
                rows = [(i, field, a, b, kind, t[a:b]) for i, t, items in zip(part["id"], texts, find_all(texts, shipped.value)) for a, b, kind in items]
                yield pd.DataFrame(rows, columns=["id", "field_name", "start", "end", "pii_type", "pii_text"])

    return emails.select("id", "content", "sender").mapInPandas(scan, "id long, field_name string, start int, end int, pii_type string, pii_text string")


def redacted(emails: DataFrame) -> DataFrame:
    """(id, content, sender) with [NAME], [EMAIL], [PHONE], [ID_NUMBER] and [ADDRESS] in place of the items; nulls stay null."""
    shipped = emails.sparkSession.sparkContext.broadcast(personal_model())

    def replace(text: str | None, items: list[tuple[int, int, str]]) -> str | None:
        for a, b, kind in sorted(items, reverse=True):
            text = f"{text[:a]}[{kind}]{text[b:]}"
        return text

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = {"id": part["id"]}
            for field in ("content", "sender"):
                texts = part[field].tolist()
                out[field] = [replace(t, i) for t, i in zip(texts, find_all(texts, shipped.value))]
            yield pd.DataFrame(out)

    return emails.select("id", "content", "sender").mapInPandas(scan, "id long, content string, sender string")
