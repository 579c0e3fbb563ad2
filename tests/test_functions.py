from pyspark.sql import functions as F

from maskwright.functions import tags
from maskwright.functions import text as T


def values(spark, items, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r[0] for r in df.select(expr(F.col("x")).alias("y"), "i").orderBy("i").select("y").collect()]


def test_plain_amounts(spark):
    items = ["$1,945.50", "12%", "123456", "1234567", "1,234,567.00", "abc", "€ 5", "12.5", "555-1234", ""]
    assert values(spark, items, T.is_plain_amount) == [True, True, True, False, True, False, True, True, False, False]


def test_short_numbers(spark):
    assert values(spark, ["94", "1945678", "A94", "12/05", "(512)", "", "$5"], T.is_short_number) == [True, False, False, True, False, False, True]


def test_ids(spark):
    assert values(spark, ["3A4F9C2B1D0E", "123456789012", "ABCDEFABCDEF", "1234567E8901", "3a4f9c2b1d0e", "3A4F9C2B1D0"], T.is_valid_id) == [True, False, False, False, False, False]


def test_luhn_ignores_separators(spark):
    assert values(spark, ["4111 1111 1111 1111", "4111-1111-1111-1112"], T.luhn) == [True, False]


def test_html(spark):
    page = "<html><script>x<p></script><p>One<br/>two</p><style>a{}</style>&amp; <b>three</b></html>"
    assert values(spark, [page], T.html_to_text) == ["One\ntwo\n\n &amp; three"]


def test_rtf(spark):
    assert values(spark, [r"{\rtf1\ansi Hello \b world\b0 \'e9}"], T.rtf_to_text) == ["Hello world"]


def test_chunks_cover_the_text(spark):
    text = "".join(chr(97 + i % 26) for i in range(1000))
    (found,) = values(spark, [text], lambda c: T.chunks(c, 50, 10))
    assert found[0] == text[:200] and found[1] == text[160:360] and found[-1].endswith(text[-1]) and len(found) == 6
    assert values(spark, ["", "short"], lambda c: T.chunks(c, 50, 10)) == [[""], ["short"]]


def test_decoding(spark):
    df = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9"),)], "content binary")
    assert [r[0] for r in df.select(T.decoded(F.col("content"))).collect()] == ["é", "é"]


def test_tags(spark):
    assert tags.allowed_tags(["phone", "email", "nothing"]) == ["EMAIL", "PHONE"]
    assert tags.tag_table(spark).count() == 17 and tags.format_table(spark).count() == 16


def test_escape_round_trip(spark):
    assert values(spark, ["<a & \"b\" 'c'>"], lambda c: T.xml_unescape(T.xml_escape(c))) == ["<a & \"b\" 'c'>"]
    references = ["Jos&#233; &#xE9;&#X1F600;", "&amp;lt; &#0038;lt;", "&#xD800; &#0; &#1114112; &nbsp; a & b;", "", None]
    assert values(spark, references, T.xml_unescape) == ["José é😀", "&lt; &lt;", references[2], "", None]


def test_names_notes_and_stamps(spark):
    assert values(spark, ["a/b\\c d?.csv", "x.y-z_1", ""], T.safe_name) == ["c_d_.csv", "x.y-z_1", ""]
    assert values(spark, ["[EMAIL_0A1B2C3D4E5F]", "ID_12AB", "[x]", "EMAIL"], T.tag_of) == ["EMAIL", "ID", "", ""]
    (note,) = values(spark, ["body [ID_12AB]"], T.copy_note)
    assert note.endswith("\n\nbody [ID_12AB]") and "exactly as written" in note
    assert values(spark, ["2024-05-01 10:00:00"], lambda c: T.utc_stamp(F.to_timestamp(c))) == ["2024-05-01T10:00:00Z"]
    assert values(spark, ["PERSON", "GENDER", "none"], tags.tag_rank) == [1, 17, 0]
    assert set(tags.HELP) == set(tags.TAGS)
