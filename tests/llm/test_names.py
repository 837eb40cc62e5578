from quillstack.llm import names as N

SCHEMA = "entity_type string, entity_text string, normalized_form string, id long, words string, kind string, name string, n int"


def linked(frame, *texts, kind="PERSON"):
    rows = [(kind, t, None, 1, "", "", "", 1) for t in texts]
    return {(r["name_1"], r["name_2"]) for r in N.variant_pairs(N.name_groups(frame(SCHEMA, *rows))).collect()}


def brute_lcs(a, b):
    m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
    return m[-1][-1]


def test_lcs():
    for a, b in [("kirivastad", "kirivastda"), ("abc", ""), ("", ""), ("aaaa", "aa"), ("xyz", "abc"), ("margaret", "agmarret")]:
        assert N.lcs(a, b) == brute_lcs(a, b)


def test_people(frame):
    forms = ["Elizabeth Rositolind", "Rositolind, Liz", "ROSITOLIND, Elizabeth B.", "E. Rositolind", "elizabeth  rositolind", "Elizabeth Rositolnid", "Elizabeth Rositolind, Esq."]
    others = ["Margaret Rositolind", "Hugo Varenistad", "Hugo Varakepell"]
    got = linked(frame, *forms, *others, *forms)
    assert got == {(min(a, b), max(a, b)) for a in forms for b in forms if a != b}


def test_ambiguous_initials_stay_apart(frame):
    got = linked(frame, "Anna Belavich", "Alice Belavich", "A. Belavich")
    assert got == set()


def test_firms(frame):
    forms = ["Southxiton Law Offices Company", "The Southxiton Law Ofcs. Co.", "Law Offices - Southxiton", "Southxiton-Law Offices", "SOUTHXITON LAW OFFICES COMPANY", "Southxuton Law Offices Company"]
    got = linked(frame, *forms, "Southxiton Insurance Agency Inc.", "Starzoport Law Offices", kind="ORG")
    assert got == {(min(a, b), max(a, b)) for a in forms for b in forms if a != b}


def test_edges(frame):
    assert linked(frame) == set()
    assert linked(frame, None, "", "  ", "x" * 20_000, "Anna", "!!", "A.") == set()
    dates = frame(SCHEMA, ("DATE", "1 May", None, 1, "", "", "", 1), (None, "Anna Belavich", None, 1, "", "", "", 1))
    assert N.name_groups(dates).count() == 0


def test_slips_of_common_names_are_candidates(frame):
    """Slips at the beginning, middle and end of the other word, where given name or surname are in more than COMMON identities."""
    pairs = [("Ysuuf", "Yusuf"), ("Marta", "Amrta"), ("Elbert", "Lbert"), ("Tobian", "Tobina"), ("Xander", "Zander")]
    many = ["".join(chr(97 + (i * k) % 23) for k in (3, 5, 7, 11, 13)) + "q" * (i % 9) for i in range(60)]
    people = [sorted(("oskobizer", w.lower())) for w in [*many, *[w for p in pairs for w in p]]]
    got = {(r["a"], r["b"]) for r in N.blocked_pairs(frame("id string, words array<string>", *[(" ".join(w), w) for w in people])).collect()}
    slips = {(" ".join(min(x, y)), " ".join(max(x, y))) for x in people for y in people if x < y and N.slip(x, y)}
    assert len(slips) >= 3 and {tuple(sorted(p)) for p in slips} <= got
