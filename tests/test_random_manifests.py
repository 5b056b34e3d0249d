"""Manifests put together at random, read back against what was put in and against the formats' own readers."""

import json
import random
import tomllib

from quarrylight.sources import manifests

NAMES = ["left", "right-pad", "Django", "zope.interface", "my_lib", "@scope/pkg", "x2", "a-b.c_d"]


def rows(spark, files):
    out = {}
    for r in manifests.inventory(spark.createDataFrame(files, "path string, content string")).collect():
        out.setdefault(r["path"], []).append(r)
    return out


def plain(name):
    for c in "_.":
        name = name.replace(c, "-")
    return name.lower()


def test_requirements(spark):
    rng = random.Random(1)
    files, want = [], {}
    for i in range(60):
        lines, told = [], set()
        for name in rng.sample([n for n in NAMES if n[0] != "@"], rng.randrange(1, 6)):
            specs = rng.choice([[], ["==1.2.3"], [">=1", "<2"], ["~=1.4"], ["==1.*"], ["!=1.1", ">1.0"]])
            mark = rng.choice(["", " ; python_version < '3.9'"])
            lines.append(name + rng.choice(["", "[extra]"]) + rng.choice([" ", ""]) + ", ".join(specs) + mark + rng.choice(["", "  # why"]))
            told.add((plain(name), ",".join(sorted(specs)) or None, specs[0][2:] if specs == ["==1.2.3"] else None))
        lines += rng.sample(["", "# note", "--index-url https://x.example", "-f ./wheels", "-i https://y.example"], 2)
        rng.shuffle(lines)
        files.append((f"{i}/requirements.txt", "\n".join(lines) + "\n"))
        want[f"{i}/requirements.txt"] = told
    got = rows(spark, files)
    assert {p: {(r["package"], r["constraint"], r["resolved"]) for r in rs} for p, rs in got.items()} == want
    text = dict(files)
    assert all(r["package"] in plain(text[p].split("\n")[r["line"] - 1]) for p, rs in got.items() for r in rs)


def test_package_json(spark):
    rng = random.Random(2)
    sections = {"dependencies": "direct", "devDependencies": "dev", "optionalDependencies": "optional", "peerDependencies": "peer"}
    files = []
    for i in range(60):
        made = {s: {n: rng.choice(["^1.0.0", "~2.1", "*", "1.2.3", ">=1 <2"]) for n in rng.sample(NAMES, rng.randrange(4))} for s in sections if rng.random() < 0.7}
        made |= {"name": "left-out", "scripts": {"left": "no dependency"}}
        files.append((f"{i}/package.json", json.dumps(made, indent=rng.choice([None, 2]))))
    got = rows(spark, files)
    for path, text in files:
        read = json.loads(text)
        want = sorted((n.lower(), c, k) for s, k in sections.items() for n, c in read.get(s, {}).items())
        assert sorted((r["package"], r["constraint"], r["kind"]) for r in got.get(path, [])) == want
        assert all(r["ecosystem"] == "npm" and r["resolved"] is None for r in got.get(path, []))


def test_pyproject_and_locks(spark):
    rng = random.Random(3)
    files = []
    for i in range(40):
        names = rng.sample([n for n in NAMES if n[0] != "@"], 4)
        files.append((f"{i}/pyproject.toml", f'[project]\nname = "p"\ndependencies = ["{names[0]}>=1", "{names[1]}==2.0"]\n[project.optional-dependencies]\ndocs = ["{names[2]}"]\n[tool.poetry.dependencies]\npython = "^3.9"\n"{names[3]}" = "==4.1"\n'))
        files.append((f"{i}/poetry.lock", "".join(f'[[package]]\nname = "{n}"\nversion = "{rng.randrange(9)}.{k}"\noptional = {str(k == 2).lower()}\n' for k, n in enumerate(names))))
        files.append((f"{i}/Pipfile.lock", json.dumps({"default": {names[0]: {"version": "==1.0"}}, "develop": {names[1]: {"version": "==2.5"}, names[2]: {"path": "."}}})))
    got, text = rows(spark, files), dict(files)
    for path, content in files:
        found = sorted((r["package"], r["resolved"], r["kind"]) for r in got[path])
        if path.endswith(".toml"):
            read = tomllib.loads(content)
            a, b = read["project"]["dependencies"]
            c, d = read["project"]["optional-dependencies"]["docs"][0], next(n for n in read["tool"]["poetry"]["dependencies"] if n != "python")
            assert found == sorted([(plain(a[:-3]), None, "direct"), (plain(b[:-5]), "2.0", "direct"), (plain(c), None, "optional"), (plain(d), "4.1", "direct")], key=lambda r: r[0])
        elif path.endswith("poetry.lock"):
            assert found == sorted((plain(p["name"]), p["version"], "optional" if p["optional"] else "direct") for p in tomllib.loads(content)["package"])
        else:
            read = json.loads(content)
            assert found == sorted([(plain(n), s.get("version", "").lstrip("=") or None, "direct" if k == "default" else "dev") for k in read for n, s in read[k].items()], key=lambda r: r[0])
    assert text
