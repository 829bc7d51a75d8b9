"""Dates, titles, owners, sentences and names of documents, on papers with known answers."""

import pytest
from pyspark.sql import functions as F

from siftstone.docinfo import analyze, columns, dates, highlights, months, titles


@pytest.fixture(scope="module")
def analyst(spark):
    return analyze.Analyst(months.by_name(spark))


@pytest.mark.parametrize(
    "text,want",
    [
        ("Lyon, le 9 mars 2031\nMadame,", ("2031-03-09", 3)),
        ("Vencimento: 10/02/2030\nEmitido em 05/02/2030", None),
        ("Vencimento: 10/02/2030\n\nDocumento emitido em Braga a 05/02/2030", ("2030-02-05", 2)),
        ("Due 2030-01-01", None),
        ("the and of to is for that 04/05/2030 on the", None),
        ("the and of to is for that 04/05/2030 and dated 04/25/2030", ("2030-04-25", 2)),
        ("Nos termos da Lei nº 1.234, de 5 de maio de 2001, segue o texto.", None),
        ("DECRETO Nº 77, DE 6 DE JUNHO DE 2021\nArt. 1", ("2021-06-06", 3)),
        ("a\n12/10/2029, 08:15\nb", None),
        ("Assinado eletronicamente por Rui em 07/07/2027", ("2027-07-07", 0)),
        ("this 21st day of June, 2033 at noon", ("2033-06-21", 4)),
        ("aos trinta dias do mês de abril do ano de mil novecentos e noventa e nove", ("1999-04-30", 6)),
        ("2028. május 4", ("2028-05-04", 3)),
        ("31 de abril de 2026", None),
        ("北京，2030年2月3日", ("2030-02-03", 3)),
    ],
)
def test_own_date(analyst, text, want):
    assert analyst.reader.own(text) == want


def test_many_dates(analyst):
    text = "\n".join(f"line {k}: {k % 28 + 1:02}/0{k % 9 + 1}/20{k % 90 + 10}" for k in range(4000)) + "\nOslo, 1 June 2030\n"
    assert analyst.reader.own(text)[0] == "2030-06-01"
    assert len(analyst.reader.dates(text)) == 4001


def test_number_words():
    assert dates.number("dois mil e dezoito".split()) == 2018
    assert dates.number("veintidós".split()) == 22
    assert dates.number("cento e um".split()) == 101
    assert dates.number(["x"]) is None
    assert dates.year_at("mil novecentos e oitenta, na sede", 0)[0] == 1980
    assert dates.year_at("2031; fim", 0) == (2031, 5)


@pytest.mark.parametrize(
    "lines,want",
    [
        (["Subject: Budget of the club", "From: A <a@b>"], "Budget of the club"),
        (["Subject: (no subject)", "From: A <a@b>"], None),
        (["Review Article", "A quiet look at small rivers", "A. Bell, C. Dunn"], "A quiet look at small rivers"),
        (["The need to", "Save water in towns", "More text here follows and goes on."], "The need to Save water in towns"),
        (["Name: Ann", "x@y.z", "A sentence that ends here."], None),
        (["GOVERNO DE ALGUM LUGAR", "CONTRATO DE COMPRA"], "CONTRATO DE COMPRA"),
        (["UNIVERSIDADE DE ALGUM LUGAR", "12 de maio de 2020"], "UNIVERSIDADE DE ALGUM LUGAR"),
        (["山中的小河", "第一章。"], "山中的小河"),
    ],
)
def test_title(analyst, lines, want):
    got = titles.title("\n".join(lines), (), analyze.names_a_kind, analyst.in_passing, analyst.reader.is_date_line)
    assert got == want


def test_prominent_and_declared(analyst):
    line = analyst.reader.is_date_line
    assert titles.prominent_title(["EDI T OR I A L", "Original Article", "Small rivers of the north"], line) == "Small rivers of the north"
    assert titles.prominent_title(["94 KB", "Small rivers"], line) is None
    text = "Small rivers of the north\nby Ann"
    assert titles.declared_title("Microsoft Word - Small rivers north.docx", text) == "Small rivers north"
    assert titles.declared_title("Small rivers of the north | River News", text) == "Small rivers of the north"
    assert titles.declared_title("Great lakes of the south", text) is None
    assert titles.declared_title("untitled", text) is None


@pytest.mark.parametrize(
    "text,kind,want",
    [
        ("Razão social: Moinho Azul Ltda.\nCliente: Rui", None, "Moinho Azul Ltda"),
        ("Client: Vera Blum, of Ulm", None, "Vera Blum"),
        ("From: Ann Lee <a@b.c>", None, "Ann Lee"),
        ("x\nEu, Marta Reis, declaro", None, "Marta Reis"),
        ("MARTA D'AVILA REIS\nCurriculum", "curriculo", "Marta D'Avila Reis" if titles.PERSON.match("Marta D'Avila Reis") else None),
        ("Town Council of Ulm -\ntext", None, "Town Council of Ulm"),
        ("nothing here", None, None),
    ],
)
def test_entity(text, kind, want):
    assert titles.main_entity(text, kind) == want


def test_kind_and_name(analyst):
    assert analyst.kind("A note on rivers\nThis long line of running prose speaks in passing of the annual report and more") is None
    assert analyst.kind("Case Report\nA man and his dog") == ("artigo", "en")
    assert analyst.kind("CONTRATO DE COMPRA") == ("contrato", "pt")
    assert analyze.file_name("2030-01-02", "Invoice", "A/B: c?", "pdf") == "2030-01-02 Invoice A-B - c.pdf"
    assert analyze.file_name(None, None, None, "txt") == "documento.txt"
    assert analyze.file_name(None, None, "ATA DA 2ª REUNIÃO", "odt") == "Ata da 2ª reunião.odt"
    assert len(analyze.file_name(None, None, "word " * 90, "pdf")) <= 124
    assert len(analyze.file_name(None, None, "語" * 120, "pdf").encode()) <= 255
    assert analyze.cut("the end of the", 100) == "the end"


def slow_highlights(text):
    """The greedy choice with similarities counted pair by pair."""
    said = highlights.sentences(text)
    x = [list(map(float, row)) for row in highlights.weights(said)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    centre = [sum(c) / len(x) for c in zip(*x)]
    size = dot(centre, centre) ** 0.5
    rel = [dot(v, centre) / size for v in x]
    chosen, words = [], 0
    while len(chosen) < len(said):
        best = max((k for k in range(len(said)) if k not in chosen), key=lambda k: (round((0.6 * rel[k] - 0.4 * max([dot(x[k], x[j]) for j in chosen], default=0.0)) * 1e9), -k))
        n = len(said[best].split())
        if words and words + n > 90:
            break
        chosen.append(best)
        words += n
    return " ".join(said[k] for k in sorted(chosen))


def test_highlights():
    import random

    r = random.Random(3)
    words = "river stone water bridge cold night boat light town winter fish north road".split()
    text = " ".join(" ".join([r.choice(words).capitalize(), *(r.choice(words) for _ in range(r.randrange(6, 20)))]) + "." for _ in range(40))
    got = highlights.extract(text)
    assert got == slow_highlights(text) and len(got.split()) <= 90
    assert highlights.extract("a b\nc d\n" * 30) is None and highlights.extract("") is None
    assert highlights.sentences("Label: some words that follow it here now.\n- an item of the list with words here") == []


@pytest.mark.parametrize("lead", ["Text of that end.", "As palavras nasc de cionasco."])
def test_signed_paragraph(analyst, lead):
    """What another paragraph ends with says nothing of a date whose own line does; a line right above still does."""
    filler = "Some words of a text.\n" * 30
    assert analyst.reader.own(f"{filler}{lead}\n\nPorto Alegre, 17 de abril de 2026.") == ("2026-04-17", 4)
    assert analyst.reader.own(f"{filler}{lead}\n\nAos onze dias do mês de maio do ano de dois mil e dezoito, encerrou a sessão.") == ("2018-05-11", 4)
    assert analyst.reader.own(f"{filler}nascimento\nPorto Alegre, 17 de abril de 2026.") == ("2026-04-17", 1)
    assert analyst.reader.own(f"{filler}Due\n\n2030-01-01") is None


def test_entity_far_down():
    """A party is found wherever its line stands, and a declaration wherever it is made."""
    far = "A line of the text that says nothing of it.\n" * 2000
    assert titles.main_entity(f"{far}Client: Vera Blum, of Ulm", None) == "Vera Blum"
    assert titles.main_entity(f"{far}Eu, Marta Reis, declaro", None) == "Marta Reis"
    assert titles.main_entity(f"{far}Town Council of Ulm", None) is None


def test_sentences_keep_their_digits(spark):
    """A sentence isn't trimmed of the digits of its own number, and is of its spaces."""
    text = "Zero words stand in this one.\n1 river and 1 bridge make up 1\n23.5 boats went over to town 2 "
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert rows.select(columns.sentences(F.col("text")).alias("s")).first()["s"] == ["Zero words stand in this one.", "1 river and 1 bridge make up 1", "23.5 boats went over to town 2"]
    got = {(x["sentence"], x["term"]) for x in columns.tfidf(rows).collect()}
    assert (2, "23") in got and (2, "3") not in got


def test_analyze_table(spark):
    rows = [(1, "Plans of the small town\nTown Council\nOslo, 1 June 2030", "txt", None), (2, None, None, "x"), (3, "", "md", None)]
    df = spark.createDataFrame(rows, "id long, text string, ext string, kind string")
    got = {x["id"]: x for x in analyze.analyze(df).collect()}
    assert got[1]["date"] == "2030-06-01" and got[1]["title"] == "Plans of the small town" and got[1]["kind"] is None
    assert got[2]["suggested_name"] == "documento" and got[3]["suggested_name"] == "documento.md"
    assert analyze.analyze(df.limit(0)).collect() == []


def test_analyze_only(spark):
    """Columns that are asked for alone are those of the whole result; others of the table stay."""
    text = "The river ran by the old stone bridge. The bridge was built of old stone by the town.\nOslo, 1 June 2030"
    df = spark.createDataFrame([(1, text, "x"), (2, None, None)], "id long, text string, title string")
    whole = {x["id"]: x for x in analyze.analyze(df).collect()}
    some = analyze.analyze(df, ("highlights",))
    assert some.columns == ["id", "text", "title", "highlights"]
    assert {x["id"]: (x["title"], x["highlights"]) for x in some.collect()} == {1: ("x", whole[1]["highlights"]), 2: (None, None)}
    date = analyze.analyze(df, ("date", "date_score")).collect()
    assert {x["id"]: (x["date"], x["date_score"]) for x in date} == {k: (x["date"], x["date_score"]) for k, x in whole.items()}
