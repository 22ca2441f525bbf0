from pyspark.sql import functions as F

from strata.functions.paths import normalize_repo_url, repo_name_from_url, directory_prefixes
from strata.functions.regex_literal import ascii_lower, required_literals
from strata.functions.text import split_lines, snippet_from_lines, with_lines, read_text_lossy


def test_split_lines_matches_splitlines(spark):
    texts = ["a\nb\n", "a\n\n", "", "a\r\nb", "x\ry\u2028z", "no break"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(split_lines("t")).collect()]
    assert got == [t.splitlines() for t in texts]
    got2 = [r[0] for r in with_lines(df, "t", keep=[]).collect()]
    assert got2 == [t.splitlines() for t in texts]


def test_snippet_first_and_last_line(spark):
    df = spark.createDataFrame([(["l1", "l2", "l3"],)], "ls array<string>")
    first, last = df.select(snippet_from_lines("ls", F.lit(1)), snippet_from_lines("ls", F.lit(3))).first()
    assert first == "l1\nl2" and last == "l2\nl3"


def test_repo_url_strips_literal_git_suffix(spark):
    df = spark.createDataFrame([("https://github.com/a/digit",), ("https://github.com/a/b.git/ ",)], "u string")
    got = [r[0] for r in df.select(repo_name_from_url("u")).collect()]
    assert got == ["a/digit", "a/b"]
    assert df.select(normalize_repo_url("u")).first()[0] == "https://github.com/a/digit"


def test_directory_prefixes(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("root.py",)], "p string")
    got = [r[0] for r in df.select(directory_prefixes("p")).collect()]
    assert got == [["a", "a/b"], []]


def test_lossy_read_universal_newlines(spark):
    df = spark.createDataFrame([("a\r\nb\rc",)], "t string")
    assert df.select(read_text_lossy("t")).first()[0] == "a\nb\nc"


def test_required_literals():
    assert required_literals(r"Licen[sc]e") == {"licen"}
    assert required_literals(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}") == {"@"}
    assert required_literals(r"a[0-9]+_ ?x") is None  # one letter is everywhere
    assert required_literals(r"(?i)eval\(") == {"eval("}
    assert required_literals(r"(?i)skin", 0) is None and required_literals(r"(?i)task(?-i:S)") == {"ta"}
    assert required_literals(r"aa|bb") == {"aa", "bb"} and required_literals(r"aa|b") is None
    assert required_literals(r"(password|secret|to(?:ken|ll))\s*=\s*[\"']") == {"password", "secret", "to"}
    assert required_literals(r"abb?c") == {"ab"} and required_literals(r"x{0,2}yz") == {"yz"}
    assert required_literals(r"(?:foo)*") is None and required_literals(r"(?:foo){2,}") == {"foo"}
    assert required_literals(r"(?<=xy)\bzz(?!q)w") == {"zzw"}
    assert ascii_lower("ABC\u0130\u00c4z") == "abc\u0130\u00c4z"



def test_hidden_files_keep_config_suffixes(spark):
    from strata.functions.paths import is_hidden
    df = spark.createDataFrame([(".env",), (".local.env",), ("a/.gitignore",), ("a/.x.gitignore",), ("b.py",)], "p string")
    assert [r[0] for r in df.select(is_hidden("p")).collect()] == [True, False, True, False, False]


def test_language_catalogue_as_a_parameter(spark, tmp_path):
    from strata.functions.languages import detect_language, read_language_map
    path = tmp_path / "languages.csv"
    path.write_text("suffix,language\n.ADA,ada\n.f90,fortran\n.py,python\n")
    files = spark.createDataFrame([("a.ada",), ("b.F90",), ("c.rake",), ("Dockerfile",)], "path string")
    catalogue = read_language_map(spark, str(path))
    got = {r.path: r.language for r in detect_language(files, language_map=catalogue).collect()}
    assert got == {"a.ada": "ada", "b.F90": "fortran", "c.rake": "plaintext", "Dockerfile": "dockerfile"}
    assert {r.path: r.language for r in detect_language(files).collect()}["c.rake"] == "ruby"
