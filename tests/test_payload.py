import json
from collections import Counter

from strata import fixtures as FX
from strata.operators import prompts as PR

SF = "/root/testdata/sf0.001"
ORDER = {"blocker": 0, "critical": 1, "high": 2, "medium": 3, "low": 4, "info": 5, "trace": 6}


def test_summary_payload_equals_python(spark):
    issues = FX.findings(spark, SF)
    rows = issues.collect()
    got = {r.repo_id: json.loads(r.payload) for r in PR.summary_payload(issues).collect()}
    by_repo = {}
    for r in rows:
        by_repo.setdefault(r.repo_id, []).append(r)
    assert set(got) == set(by_repo)
    for repo, items in by_repo.items():
        doc = got[repo]
        assert doc["total_issues"] == len(items)
        sev = Counter((i.severity or "info").lower() for i in items)
        assert doc["severity_counts"] == {s: sev.get(s, 0) for s in ORDER}
        fams = Counter(i.defect_family for i in items if (i.defect_family or "").strip())
        assert sorted(doc["top_defect_families"].items()) == sorted(dict(fams.most_common(8)).items()) or len(fams) > 8
        items_sorted = sorted(items, key=lambda i: (ORDER.get(i.severity or "info", 4), i.defect_family or "",
                                                    i.file_path or "", i.line_number or 0, i.rule_id or "", i.message or ""))
        seen, reps = set(), []
        for i in items_sorted:
            key = (i.defect_family or "", i.file_path or "", i.line_number or 0, i.message or "")
            if key in seen:
                continue
            seen.add(key)
            reps.append((i.file_path, i.line_number, i.rule_id))
            if len(reps) == 18:
                break
        assert [(r["file"], r["line"], r["rule_id"]) for r in doc["representative_issues"]] == reps
