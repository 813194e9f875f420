"""A small study bundle on disk, and the study that it belongs to."""

import json
import os

import yaml

from evalloom.plans.bundle import Study

TASKS = ["rule_identification", "correction", "joint", "explanation"]
PROFILES = {"main": {"max_steps": 600, "betas": [0.9, 0.999], "caps": {"joint": 512, "correction": 512}}}
ROW = {"use_summary": None, "auxiliary_pool": None, "auxiliary_ratio": None, "prompt_form": None}
CONDITIONS = {
    "C0": ROW | {"kind": "fine_tuned", "path": "c0", "seeds": [42, 43], "configuration_id": "main-c0", "use_summary": False, "auxiliary_ratio": 0.0},
    "C1": ROW | {"kind": "fine_tuned", "path": "c1", "seeds": [42, 43], "configuration_id": "main-c1", "use_summary": True, "auxiliary_ratio": 0.2},
    "zero-shot-raw": ROW | {"kind": "zero_shot", "path": "zero-shot-raw", "seeds": [42], "configuration_id": "main-raw", "prompt_form": "raw"},
}
IDS = ["sha256:" + f"{i:064x}" for i in range(5)]
STUDY = Study(CONDITIONS, "rev-1", "model-1", {"fine_tuned": "a" * 40, "zero_shot": "b" * 40}, PROFILES, counts={"records": 16, "test": 4, "excluded": 1, "quarantined": 0, "scored": 12})
STEPS = [120, 240, 360, 480, 600]


def record(i, condition, seed, task):
    out = {"base_snippet_id": i, "condition": condition, "seed": seed, "task_type": task, "target_checks": ["elseif"], "summary_status": "present", "prompt_tokens": 10, "retokenized_response_token_proxy": 3, "latency_ms": 1.5}
    if task == "rule_identification":
        out |= {"gold": ["elseif"], "pred": ["elseif"], "rejected_label_count": 0, "exact_match": True, "n_emitted": 1, "normalization_status": "recognized_array"}
    if task in ("correction", "joint"):
        out["outcome"] = {"target_fixed": True, "overall_fixed": True, "studied_regression": None, "enabled_regression": False, "extracted": True, "extraction_status": "go_block", "parse_ok": True, "lint_ok": True, "original_tool_status": "ok", "output_tool_status": "ok", "build_status": "FAIL", "category": "A", "introduced_checks": [], "residual_findings": [{"check": "elseif", "line": 1, "column": 2}]}
    return out


def identity(c, s):
    return {"historical_run_id": f"run-{CONDITIONS[c]['path']}-{s}", "condition": c, "seed": s, "profile": "main"}


def results(c, s):
    tuned = CONDITIONS[c]["kind"] == "fine_tuned"
    num = lambda **kw: kw if tuned else dict.fromkeys(kw)
    return identity(c, s) | {
        "metrics": {
            "checkpoint_selection": num(selected_step=480, best_composite=0.7, rule_id_macro_f1=0.6, correction_fix_rate=0.5, joint_fix_rate=0.4),
            "compute": num(optimizer_steps=600, examples_seen=19200, total_tokens=1000 + s, supervised_tokens=300, peak_allocated_gpu_memory_gib=40.5, wall_clock_train_s=60.0, wall_clock_total_s=90.5),
            "length": num(allowed_max_length=9305, realized_truncation=0),
            "provenance": {"dataset_revision": "rev-1", "model_identifier": "model-1", "data_fraction": 1.0, "historical_source_commit": STUDY.commits[CONDITIONS[c]["kind"]], "run_kind": CONDITIONS[c]["kind"]},
        }
    }


def manifest(c, s):
    return identity(c, s) | {"dataset_revision": "rev-1", "historical_source_commit": STUDY.commits[CONDITIONS[c]["kind"]], "configuration_id": CONDITIONS[c]["configuration_id"]}


def trace(c):
    if CONDITIONS[c]["kind"] == "zero_shot":
        return []
    return [{"step": k, "validation_loss": 1.0, "composite_score": 0.7 if k == 480 else 0.3, "rule_id_macro_f1": 0.6, "correction_fix_rate": 0.5, "joint_fix_rate": 0.4} for k in STEPS]


def study_row(k):
    return {
        "base_snippet_id": IDS[k], "split": "test" if k < 4 else "train", "task_types": TASKS, "target_checks": ["elseif"], "violation_count": 1, "repository_group_id": f"repository-group-{k:04d}", "length_excluded": False, "quarantined": False,
        "oracle": {"status": "excluded" if k == 0 else "reproduced", "missing_checks": [], "extra_checks": []}, "source_line_count": 4,
        "serializer": {"parse_ok": True, "parse_strategy": "file", "excluded_construct_count": 0, "maximum_depth": 2, "summary_status": "present"},
        "dataset_qc": {"exact_collision": False, "canonical_normalization_sampled": False, "canonical_normalization_changed": False, "pair_indicators": [{"other_base_snippet_id": IDS[0], "kind": "near_duplicate", "threshold": 0.8, "score": 0.9, "matched": True}]},
        "reference_qc": {"correction_status": "accepted", "explanation_present": True, "primary_category_a": True, "secondary_category_a": None, "normalized_fixes_equal": None, "selected_generator_role": "primary", "generation_attempts": 1, "skip_mechanism": "none", "generated_marker_retained": False, "accepted_correction_byte_identical": None, "build_status": "OK"},
        "training_contributions": [], "serializer_audit_stage1_pool_member": False, "serializer_audit": None, "violation_in_closure": None, "license_class": "permissive",
    }


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def build(root):
    config = {"schema_version": 1, "dataset": {"identifier": "d", "doi": "10.1/x", "revision": "rev-1"}, "model": {"identifier": "model-1"}, "profiles": PROFILES, "conditions": CONDITIONS}
    write(f"{root}/config/experiments.yaml", yaml.safe_dump(config, sort_keys=False))
    targets = [{"id": f"r.{i}", "manuscript_locations": ["section:1#a"], "target": {"kind": "json", "file": "results.json", "identifier": f"r.{i}", "row": None, "column": None}} for i in range(2)]
    write(f"{root}/config/manuscript_results.yaml", yaml.safe_dump({"schema_version": 1, "results": targets}, sort_keys=False))
    write(f"{root}/data/study/analysis_inputs.jsonl", lines(study_row(k) for k in range(5)))
    for c, _, s, _, _ in STUDY.runs():
        run = f"{root}/data/runs/{CONDITIONS[c]['path']}/seed-{s}"
        write(f"{run}/records.jsonl", lines(record(i, c, s, t) for i in IDS[:4] for t in TASKS))
        write(f"{run}/results.yaml", yaml.safe_dump(results(c, s), sort_keys=False))
        write(f"{run}/manifest.yaml", yaml.safe_dump(manifest(c, s), sort_keys=False))
        write(f"{run}/selection_trace.json", json.dumps(trace(c)))
    return str(root)
