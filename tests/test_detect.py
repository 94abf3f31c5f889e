"""Languages, projects and manifests."""

import pytest

from tessera.operators.detect import (
    PROJECT_MARKERS,
    dependencies,
    detect_projects,
    root_rollup,
    with_language,
    with_project,
)


def test_languages(spark):
    cases = {
        "main.go": "go", "FILE.GO": "go", "a.tsx": "typescript", "a.jsx": "javascript", "x.h": "c", "x.hpp": "cpp",
        "x.cc": "cpp", "README.md": "markdown", ".json": "json", "Makefile": "unknown", "a.b/c": "unknown",
        "/p/q.r/x.yml": "yaml", "file.xyz": "unknown", "trailing.": "unknown",
    }
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.language for r in with_language(df).collect()} == cases


def files(spark, entries):
    return spark.createDataFrame([(p.rstrip("/"), p.endswith("/")) for p in entries], "path string, is_dir boolean")


@pytest.fixture(scope="module")
def projects(spark):
    entries = [f"/m/{i}/{name}" for i, name in enumerate(PROJECT_MARKERS)]
    entries += ["/v/g/.git/", "/v/s/.svn/", "/v/h/.hg/", "/v/f/.git", "/i/c/.vscode/", "/i/d/.idea/", "/i/e/.idea"]
    entries += ["/two/setup.py", "/two/package.json", "/two/.hg/", "/two/.svn/", "/none/readme.md"]
    return {r.project_path: r for r in detect_projects(files(spark, entries)).collect()}


def test_markers(projects):
    got = [projects[f"/m/{i}"].project_type for i in range(len(PROJECT_MARKERS))]
    assert got == ["go", "node", "python", "python", "python", "rust", "java", "java", "ruby"]
    assert projects["/m/0"].marker == "go.mod" and not projects["/m/0"].has_vcs


def test_folders(projects):
    assert [(projects[f"/v/{x}"].has_vcs, projects[f"/v/{x}"].vcs_type) for x in "gsh"] == [
        (True, "git"), (True, "svn"), (True, "hg")
    ]
    assert "/v/f" not in projects and "/i/e" not in projects and "/none" not in projects
    assert projects["/i/c"].has_ide_config and projects["/i/d"].has_ide_config
    assert projects["/i/c"].project_type == "unknown"


def test_precedence_is_fixed(projects):
    assert (projects["/two"].project_type, projects["/two"].vcs_type) == ("node", "svn")


def test_nearest_project(spark):
    found = detect_projects(files(spark, ["/a/go.mod", "/a/b/c/setup.py", "/ab/pom.xml", "/a/b/.git/"]))
    df = spark.createDataFrame(
        [("/a/x.go",), ("/a/b/x.go",), ("/a/b/c/d/e/x.py",), ("/abc/x",), ("/ab/x",), ("x",)], "path string"
    )
    got = {r.path: (r.project_path, r.project_type) for r in with_project(df, found).collect()}
    assert got == {
        "/a/x.go": ("/a", "go"),
        "/a/b/x.go": ("/a", "go"),
        "/a/b/c/d/e/x.py": ("/a/b/c", "python"),
        "/abc/x": ("", "unknown"),
        "/ab/x": ("/ab", "java"),
        "x": ("", "unknown"),
    }


def deps(spark, marker, text):
    df = spark.createDataFrame([("p", marker, text)], "project_path string, marker string, content string")
    return {r.name: r.version for r in dependencies(df).collect()}


def test_module_file(spark):
    text = (
        "module m\n\ngo 1.23\n\nrequire (\n\tgithub.com/a/b v1.8.0\n\tgithub.com/c/d v1.9.0 // indirect\n"
        "\t// two words\n\tlonely\n)\n\nrequire single.org/x v0.1.0\nrequire short\nreplace a => b\n"
        "require (\n\tgithub.com/a/b v2.0.0\n)\nafter me v1\n"
    )
    assert deps(spark, "go.mod", text) == {
        "github.com/a/b": "v2.0.0", "github.com/c/d": "v1.9.0", "//": "two", "single.org/x": "v0.1.0"
    }


@pytest.mark.parametrize(
    "text, expected",
    [
        ('{"dependencies": {"a": "^4", "b": "1"}, "devDependencies": {"j": "2"}}', {"a": "^4", "b": "1", "j": "2"}),
        ('{"devDependencies": {"a": "dev"}, "dependencies": {"a": "prod"}}', {"a": "dev"}),
        ('{"dependencies": {"a": 1, "b": "x"}}', {}),
        ('{"dependencies": {"a": "1"}, "devDependencies": {"b": []}}', {}),
        ('{"dependencies": []}', {}),
        ('{"dependencies": null, "devDependencies": {"b": null}}', {"b": ""}),
        ('{"DEPENDENCIES": {"a": "1"}}', {"a": "1"}),
        ('{"dependencies": {"a": "1"},}', {}),
        ('{"dependencies": {"a": "1"}} trailing', {}),
        ('{"dependencies": {"a": "1"}}, {"dependencies": {"b": "1"}}', {}),
        ('[{"dependencies": {"a": "1"}}]', {}),
        ('"text"', {}),
        ("null", {}),
        ("", {}),
        ('{"name": "n"}', {}),
    ],
)
def test_package_file(spark, text, expected):
    assert deps(spark, "package.json", text) == expected


def test_other_markers_have_no_dependencies(spark):
    assert deps(spark, "Gemfile", "require x v1") == {}


def test_rollup(spark):
    listing = spark.createDataFrame(
        [("/a", "/a/x.go", False), ("/a", "/a/y.py", False), ("/a", "/a/z.py", False), ("/a", "/a/d", True), ("/b", "/b/n", False)],
        "root string, path string, is_dir boolean",
    )
    found = detect_projects(files(spark, ["/a/go.mod"]))
    manifest = spark.createDataFrame(
        [("/a", "go.mod", "require x v1\nrequire y v2")], "project_path string, marker string, content string"
    )
    got = {r.root: r for r in root_rollup(listing, found, dependencies(manifest)).collect()}
    assert (got["/a"].file_count, got["/a"].languages, got["/a"].project_type, got["/a"].dependencies) == (
        3, ["go", "python"], "go", {"x": "v1", "y": "v2"}
    )
    assert (got["/b"].file_count, got["/b"].languages, got["/b"].project_type, got["/b"].dependencies) == (1, [], "unknown", {})
