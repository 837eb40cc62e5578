from datetime import datetime

from quillstack.llm.newtext import new_lines, new_text, references, stamps

SCHEMA = "id long, message_id string, subject string, sender string, content string, datetime_utc timestamp_ntz, thread_id string, key string, ancestor string, minute int"
FIRST = "Hello Ann,\nthe roof was inspected on Friday and the report is attached.\nPlease confirm.\n\nBest,\nBob Marlen\nEngineer"


def lines(content, sender="Ann Tobrick <ann@x.example>", ancestors=()):
    return new_lines(content, sender, list(ancestors))


def test_stamps():
    assert stamps("On Mon, Sep 6, 2021 at 7:05 PM, X <x@y.z> wrote:") == ["2021-09-06 19:05"]
    assert stamps("Am 29.08.2021 17:30 schrieb X:") == ["2021-08-29 17:30"] and stamps("Sent: August 28, 2021 02:39") == ["2021-08-28 02:39"] and stamps("32.13.2021 17:30") == []


def test_quotations():
    marked = "Thanks for that.\n\nKind regards,\nAnn\n\nOn Mon, Sep 6, 2021 at 7:05 AM, Bob Marlen <b@x.example> wrote:\n> " + FIRST.replace("\n", "\n> ")
    assert lines(marked) == [1]
    below = "Bob Marlen <b@x.example> wrote on 6.09.2021 07:05:\n\n    " + FIRST.replace("\n", "\n    ") + "\n\nAgreed, we go ahead.\n\n--\nAnn"
    n = len(below.split("\n"))
    assert lines(below) == [n - 3]
    plain = "From: Bob Marlen\nSent: September 6, 2021 07:05\nSubject: Roof\n\n" + FIRST + "\n\nAgreed, we go ahead with the contractor.\n"
    assert lines(plain) == [] and lines(plain, ancestors=[FIRST]) == [len(plain.split("\n")) - 1]


def test_interleaved_and_false_marks():
    mail = "On Mon, Sep 6, 2021 at 7:05 AM, Bob <b@x.example> wrote:\n| the roof was inspected on Friday\nWhat did they find?\n| and the report is attached."
    assert lines(mail) == [3]
    assert lines("Dear all,\n> 59 days is too long for a cure period.\nTo: do list is below.\nSent from the site: three photos of the roof.") == [1, 2, 3, 4]


def test_footers():
    assert lines("The lease ended.\n\nThis e-mail and any files sent with it are meant only for the addressee.") == [1]
    assert lines("Call me.\n\nSent from my phone") == [1] and lines("Best regards to the plaintiff if you see them.\nMore follows.") == [1, 2]


def test_threads_and_edges(frame):
    reply = "Agreed.\n\nFrom: Bob Marlen\nSent: September 6, 2021 07:05\nSubject: Roof\n\n" + FIRST + "\n\nAnd another thing: the gutter leaks as well.\n"
    rows = [
        (1, "<a>", "Roof", "Bob Marlen <b@x.example>", FIRST, datetime(2021, 9, 6, 7, 5, 33), "t", "k", "a", 1), (2, "<b>", "Re: Roof", "Ann", reply, None, "t", "k", "a", 1), (3, "<a>", "Roof", "Bob", FIRST, datetime(2021, 9, 6, 7, 5, 33), None, "k", "a", 1),
        (4, None, None, None, None, None, None, None, None, None), (5, "<e>", "", None, "", None, None, None, None, None), (6, "<f>", "x", "y", "word " * 200_000 + "\r\n", None, None, None, None, None),
    ]
    got = {r["id"]: (list(r["new_lines"]), r["new_text"]) for r in new_text(frame(SCHEMA, *rows)).collect()}
    assert got[1][0] == [1, 2, 3] == got[3][0] and got[2][0] == [1, len(reply.split("\n")) - 1]
    assert got[4] == ([], "") == got[5] and got[6][0] == [1]
    assert new_text(frame(SCHEMA)).count() == 0
    assert references(None) == references("") == []
