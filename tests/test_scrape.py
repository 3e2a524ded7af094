import pytest
from pyspark.sql import functions as F

from parley import fixed_values as fixed
from parley.functions.text import word_count
from parley.operators import scrape
from parley.plans import jobs
from parley.sources.readers import read_text_folder

LONG = "A sentence that keeps going on and on so that the text is long enough. "


def one(spark, build, **columns):
    names = list(columns)
    frame = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{n} string" for n in names))
    return frame.select(build(*[F.col(n) for n in names])).first()[0]


@pytest.mark.parametrize(
    "name,topic",
    [
        ("my_first-topic.txt", "My first topic"),
        ("https_example_com__page.txt", "Https example com page"),
        ("www.site.org.txt", "Site.org"),
        ("éclair  notes.txt", "Éclair notes"),
        ("_-_.txt", ""),
        ("noext", "Noext"),
    ],
)
def test_topic_from_filename(spark, name, topic):
    assert one(spark, scrape.topic_from_filename, n=name) == topic


@pytest.mark.parametrize(
    "content,topic",
    [
        ("\n\n  Title here \nbody", "Title here"),
        ("# heading\nSecond line", "Second line"),
        ("# only a heading line", "# only a heading line"),
        ("#\n" + "w " * 20 + "\nshort", "short"),
        ("x" * 120, "x" * 100 + "..."),
        (" ".join(["word"] * 20), " ".join(["word"] * 20)),
        ("#a\n" * 10 + "title after ten lines", "title after ten lines"),
        ("#a\n#b", fixed.NO_TOPIC),
        ("", fixed.NO_TOPIC),
    ],
)
def test_topic_from_content(spark, content, topic):
    assert one(spark, scrape.topic_from_content, c=content) == topic


@pytest.mark.parametrize(
    "name,source",
    [
        ("https_example_com_article.txt", "example"),
        ("HTTPS-www-Example-com.txt", "example"),
        ("http_www_site_org.txt", "site"),
        ("news.site.txt", "news"),
        ("plain name here.txt", "plain"),
        ("www_.txt", fixed.NO_SOURCE),
        ("https.txt", fixed.NO_SOURCE),
        ("_leading.txt", ""),
        ("2024-report_v2.txt", "2024"),
    ],
)
def test_source(spark, name, source):
    assert one(spark, scrape.source_of, n=name) == source


@pytest.mark.parametrize(
    "count,label",
    [(199, "brief explanation"), (200, "article"), (499, "article"), (500, "detailed guide"),
     (999, "detailed guide"), (1000, "comprehensive resource"), (5000, "comprehensive resource")],
)
def test_content_type(spark, count, label):
    text = " ".join(["w"] * count)
    assert one(spark, lambda c: scrape.content_type_of(word_count(c, 1000)), c=text) == label


@pytest.mark.parametrize(
    "text,category",
    [("a how to text", "tutorial"), ("the capital", "documentation"), ("a theory", "concept"),
     ("a demo", "example"), ("nothing", "general information"), ("example with a step", "tutorial")],
)
def test_category(spark, text, category):
    assert one(spark, scrape.category_of, t=text) == category


@pytest.mark.parametrize(
    "text,drop,cleaned",
    [
        ("Title\nbody", True, "body"),
        ("A sentence.\nbody", True, "A sentence.\nbody"),
        ("t" * 150 + "\nbody", True, "t" * 150 + "\nbody"),
        ("\nTitle\nbody", True, "Title\nbody"),
        ("only one line", True, "only one line"),
        ("a\n\n \n \n\nb", False, "a\n\nb"),
        ("a\n\nb", False, "a\n\nb"),
        ("a \t  b  c", False, "a b  c"),
        ("x COOKIE policy we use Accept y Accept", False, "x  y Accept"),
        ("x Cookie Policy\nAccept", False, "x Cookie Policy\nAccept"),
        ("SUBSCRIBE to Newsletter now", False, "now"),
    ],
)
def test_clean(spark, text, drop, cleaned):
    assert one(spark, lambda c: scrape.clean_content(c, drop), c=text) == cleaned


METADATA = {"topic": "T", "source": "S", "content_type": "C", "category": "K", "filename": "F"}


@pytest.mark.parametrize(
    "template",
    ["{topic} {source} {content_type} {category} {filename}", "no names", "{{{topic}}}", "{topic:>4}|{source:*^6}|{category:3}|",
     "{filename:.0}x", "{topic!s}"],
)
def test_template_fills_like_format(spark, template):
    frame = spark.createDataFrame([tuple(METADATA.values())], list(METADATA))
    assert frame.select(scrape.fill_template(template)).first()[0] == template.format(**METADATA)


def test_unknown_placeholder_falls_back(spark):
    frame = spark.createDataFrame([tuple(METADATA.values())], list(METADATA))
    assert frame.select(scrape.fill_template("{topic} by {author}")).first()[0] == "Tell me about T"


@pytest.mark.parametrize("template", ["{topic", "{}", "{topic.x}", "{topic!r}", "{topic:d}"])
def test_unusable_template_is_refused(spark, template):
    with pytest.raises(ValueError):
        scrape.fill_template(template)


def test_template_choice(spark):
    frame = spark.createDataFrame([(f"file{i}",) for i in range(600)], "n string")
    picks = [r[0] for r in frame.select(scrape.choose_template(F.col("n"))).collect()]
    assert set(picks) == set(range(15))
    assert picks == [r[0] for r in frame.select(scrape.choose_template(F.col("n"))).collect()]
    assert picks != [r[0] for r in frame.select(scrape.choose_template(F.col("n"), seed="x")).collect()]
    fixed_pick = frame.select(scrape.choose_template(F.col("n"), randomize=False)).distinct().collect()
    assert [r[0] for r in fixed_pick] == [0]


def test_folder_to_pairs(spark, tmp_path):
    folder = tmp_path / "texts"
    folder.mkdir()
    (folder / "a_b c+d%.txt").write_bytes(("My Title\r\n" + LONG + "\r" + LONG).encode())
    (folder / "short.txt").write_text("too short")
    (folder / "latin.txt").write_bytes("caf\xe9 ".encode("latin-1") * 30)
    (folder / "other.md").write_text(LONG * 3)
    (folder / "nested").mkdir()
    (folder / "nested" / "deep.txt").write_text(LONG * 3)
    rows = {r.name: r.content for r in read_text_folder(spark, str(folder)).collect()}
    assert set(rows) == {"a_b c+d%.txt", "short.txt", "latin.txt"}
    ordered = [r.name for r in read_text_folder(spark, str(folder), ordered=True).collect()]
    assert ordered == sorted(rows)
    assert rows["latin.txt"] is None and "\r" not in rows["a_b c+d%.txt"]
    stats = jobs.scrape(spark, str(folder), str(tmp_path / "pairs"), randomize=False)
    assert stats == {"found": 3, "processed": 1, "too_short": 1, "unreadable": 1, "unlisted": 0}
    pair = spark.read.json(str(tmp_path / "pairs")).first()
    assert pair.input == "Tell me about My Title"
    assert pair.output == LONG.strip() + " \n" + LONG.strip()


def test_no_usable_file_is_an_error(spark, tmp_path):
    (tmp_path / "x.txt").write_text("short")
    with pytest.raises(ValueError):
        jobs.scrape(spark, str(tmp_path), str(tmp_path / "out"))


def test_scrape_chain_is_one_narrow_stage(spark):
    frame = spark.createDataFrame([("a.txt", LONG)], "name string, content string")
    plan = scrape.scrape_pairs(frame)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "Exchange" not in physical and "Python" not in physical
