import numpy as np

from quillstack.llm import scans as S

SCHEMA = "chunk_id string, text_content string, extraction_method string, word string, clean int, kind string"


def test_line_model_on_held_out_pages():
    pages, gold = S.composed_pages(60, seed=99)
    got = S.label_lines(pages, S.line_model())
    right = sum(int((g == np.array(t)).sum()) for g, t in zip(got, gold))
    assert right / sum(map(len, gold)) > 0.97


def test_words():
    assert "damage" in S.restored("darnage") and "counsel" in S.restored("coun5el")
    assert S.number_of("2O22") == "2022" and S.number_of("2020-5C-875815") == "2020-SC-875815" and S.number_of("second") is None and S.number_of("2022") is None
    assert S.with_case("5ervices", "services", False, True) == "Services" and S.with_case("IN5URANCE", "insurance", False, False) == "INSURANCE" and S.with_case("fi1ed", "filed", True, False) == "filed"


def test_repairs(frame):
    clean = "The tenant accepted the non-binding offer and the damage was described in writing. The counsel for the tenant demands a repair of the roof."
    page = "Page 3 of 9\nThe tenant acce-\npted the non-\nbinding offer and the darnage was desc-\n- 4 -\n\nribed in writing. The coun5el demands a repair in 2O22.\n\nTERMS\n\nThe roof."
    rows = [(f"d{i}", clean, "docx", "w", 1, "k") for i in range(6)] + [("s", page, "ocr", "w", 1, "k")] * 2 + [("n", None, "ocr", None, None, None), ("e", "", "ocr", None, None, None), (None, "1\n", "ocr", None, None, None), ("m", "x", None, None, None, None), ("l", "word " * 150_000, "ocr", None, None, None)]
    df = frame(SCHEMA, *rows)
    found = S.repairs(df)
    got = {(r["line_no"], r["kind"], r["word"]) for r in found.where("chunk_id = 's'").collect()}
    assert got == {(1, "furniture", ""), (5, "furniture", ""), (2, "hyphen", "accepted"), (3, "hyphen", "non-binding"), (4, "hyphen", "described"), (4, "misread", "damage"), (7, "misread", "counsel"), (7, "misread", "2022")}
    text = {r["chunk_id"]: r["text"] for r in S.repaired_texts(df, found).collect()}
    assert text["s"].split("\n\n")[0] == "The tenant accepted the non-binding offer and the damage was described in writing. The counsel demands a repair in 2022."
    assert text["n"] == text["e"] == ""


def test_empty(frame):
    assert S.repairs(frame(SCHEMA)).count() == 0
