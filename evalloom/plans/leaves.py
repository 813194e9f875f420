"""The study's result leaves, declared over frames that are each scanned once.

Families of ids come from rules over splits, tasks, checks, conditions and statuses. ``frames`` makes the frames from a
bundle. Intervals are those of ``operators.resample``; the interaction is that of ``operators.mixed``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalloom.operators import mixed, resample, stats
from evalloom.operators.leaves import Leaves, one_value, share, uniform
from evalloom.plans import study
from evalloom.plans.bundle import Bundle

# How result ids spell the study's names.
CHECK_IDS = {"assignOp": "assign_op", "builtinShadow": "builtin_shadow", "captLocal": "capt_local", "commentFormatting": "comment_formatting", "elseif": "elseif", "ifElseChain": "if_else_chain", "paramTypeCombine": "param_type_combine", "singleCaseSwitch": "single_case_switch"}
CONDITION_IDS = {"C0": "c0", "C1": "c1", "C2": "c2", "C2-control": "c2_control", "zero-shot-raw": "zero_shot_raw", "zero-shot-syntax": "zero_shot_syntax"}
SPLITS = ["train", "validation", "test"]
SYNTAX = ["C1", "C2", "C2-control"]
REPAIRS = ["correction", "joint"]

col, count_if, lit = F.col, F.count_if, F.lit


def total(c: Column) -> Column:
    return F.coalesce(F.sum(c), lit(0))


def is_true(c: str) -> Column:
    return F.coalesce(col(c), lit(False))


def dataset(out: Leaves) -> None:
    """Snippets, labels and task rows by split; the length exclusion; over study rows."""
    of = {s: col("split") == s for s in SPLITS}
    has = lambda k: F.array_contains("target_checks", k)
    task = lambda t: F.array_contains("task_types", t)
    n_labels, n_tasks = F.size("target_checks"), F.size("task_types")
    leaves = {
        "base_snippets.total": F.count("*"),
        "studied_checks.count": F.max(lit(len(study.CHECKS))),
        "task_variants_per_snippet": F.max(lit(len(study.TASKS))),
        "clean_snippets.total": count_if(col("violation_count") == 0),
        "near_duplicate_quarantine.total": count_if("quarantined"),
        "cross_split_exact_collisions.total": count_if("dataset_qc.exact_collision"),
        "canonical_normalization.changed": count_if("dataset_qc.canonical_normalization_changed"),
        "pre_qc_task_examples.total": F.count("*") * len(study.TASKS),
        "post_reference_qc.total.total": total(n_tasks),
    }
    for s, here in of.items():
        leaves |= {
            f"base_snippets.{s}": count_if(here),
            f"per_check_positives.{s}": uniform([count_if(here & has(k)) for k in study.CHECKS], f"{s} positives by check").cast("long"),
            f"label_instances.{s}": total(F.when(here, n_labels)),
            f"pre_qc_task_examples.{s}": count_if(here) * len(study.TASKS),
            f"post_reference_qc.{s}.total": total(F.when(here, n_tasks)),
        }
        leaves |= {f"post_reference_qc.{s}.{t}": count_if(here & task(t)) for t in study.TASKS}
    leaves |= {f"post_reference_qc.total.{t}": count_if(task(t)) for t in study.TASKS}
    gone, kept = of["train"] & col("length_excluded"), of["train"] & ~col("length_excluded")
    leaves |= {
        "length_exclusion.base_snippets": count_if(gone),
        "length_exclusion.label_instances.total": total(F.when(gone, n_labels)),
        "length_exclusion.multilabel_snippets": count_if(gone & (n_labels > 1)),
        "length_exclusion.reference_qc_overlap": count_if(gone & (col("reference_qc.correction_status") != "accepted")),
        "post_length.base_snippets.total": count_if(kept),
        "post_length.task_examples.total": total(F.when(kept, n_tasks)),
    }
    leaves |= {f"length_exclusion.check.{i}": count_if(gone & has(k)) for k, i in CHECK_IDS.items()}
    leaves |= {f"post_length.task_examples.{t}": count_if(kept & task(t)) for t in study.TASKS}
    out.add("study", {f"dataset.{k}": v for k, v in leaves.items()})


def reference_qc(out: Leaves) -> None:
    """Quality control of the reference fixes, over study rows of the training split."""
    q = lambda c: col(f"reference_qc.{c}")
    train = col("split") == "train"
    accepted, refused = train & (q("correction_status") == "accepted"), train & (q("correction_status") != "accepted")
    both = train & is_true("reference_qc.primary_category_a") & is_true("reference_qc.secondary_category_a")
    equal = is_true("reference_qc.normalized_fixes_equal")
    second = train & (q("selected_generator_role") == "secondary")
    off = train & (q("skip_mechanism") == "configured_but_not_applied")
    marked, multiline = off & q("generated_marker_retained"), off & ~q("generated_marker_retained")
    now = F.array_union(F.array_except("target_checks", "oracle.missing_checks"), col("oracle.extra_checks"))
    other = F.filter("target_checks", lambda k: (k != "paramTypeCombine") & F.array_contains(now, k))
    has = lambda k: F.array_contains("target_checks", k)
    leaves = {
        "correction.accepted": count_if(accepted),
        "explanation.accepted": count_if(train & q("explanation_present")),
        "correction.excluded": count_if(refused),
        "correction.exclusion.generation_attempts_each": one_value(F.when(refused, q("generation_attempts")), "attempts of excluded references").cast("long"),
        "cross_generator.both_category_a.count": count_if(both),
        "cross_generator.both_category_a.rate": share(count_if(both), count_if(train), 1.0),
        "cross_generator.normalized_fix_equal.count": count_if(both & equal),
        "cross_generator.normalized_fix_equal.rate": share(count_if(both & equal), count_if(both), 1.0),
        "substitution.count": count_if(second),
        "substitution.rate": share(count_if(second), count_if(accepted), 1.0),
        "training_targets.primary_generator": count_if(train & (q("selected_generator_role") == "primary")),
        "training_targets.secondary_generator": count_if(second),
        "deviation.skip_listed": count_if(off),
        "deviation.generated_marker": count_if(marked),
        "deviation.multiline_param": count_if(multiline),
        "deviation.multiline.no_studied_detection": count_if(multiline & (F.size(now) == 0)),
        "deviation.multiline.with_studied_detection": count_if(multiline & (F.size(now) > 0)),
        "deviation.multiline.dual_target_verified": count_if(multiline & (F.size("target_checks") > 1) & (F.size(other) > 0)),
        "deviation.marker.normalized_fix_equal": count_if(marked & equal),
        "deviation.overall.normalized_fix_equal": count_if(off & equal),
        "deviation.overall.normalized_fix_equal_rate": share(count_if(off & equal), count_if(off), 1.0),
        "deviation.byte_identical_noop": count_if(off & is_true("reference_qc.accepted_correction_byte_identical")),
        "deviation.both_generators_category_a": count_if(off & both),
        "deviation.length_excluded": count_if(off & col("length_excluded")),
        "deviation.post_length_affected": count_if(off & ~col("length_excluded")),
        "deviation.check.elseif_percent_of_training_positives": share(count_if(off & has("elseif")), count_if(train & has("elseif"))),
        "deviation.label_instances": total(F.when(off, F.size("target_checks"))),
    }
    leaves |= {f"correction.exclusion.{s}": count_if(refused & (q("correction_status") == s)) for s in ("parse_fail", "target_not_fixed")}
    for s in ("OK", "NA", "FAIL"):
        hit = count_if(accepted & (q("build_status") == s))
        leaves |= {f"build.{s.lower()}.count": hit, f"build.{s.lower()}.percent": share(hit, count_if(accepted))}
    out.add("study", {f"reference_qc.{k}": v for k, v in leaves.items()})
    some = lambda n: F.when(n > 0, n)
    out.add("study", {f"reference_qc.deviation.check.{i}": some(count_if(off & has(k))) for k, i in CHECK_IDS.items()}, optional=True)


def oracle(out: Leaves) -> None:
    """What the detector reproduces, by split and check, and why evaluation rows are excluded."""
    missing, extra, status = col("oracle.missing_checks"), col("oracle.extra_checks"), col("oracle.status")
    held = col("split").isin("validation", "test")
    excluded = held & (status == "excluded")
    scored = (status != "excluded") & ~col("quarantined")
    lacks, more = F.size(missing) > 0, F.size(extra) > 0
    same = (F.size(F.array_except(missing, "target_checks")) == 0) & (F.size(F.array_except("target_checks", missing)) == 0)
    multiline = ~more & (F.to_json(missing) == '["paramTypeCombine"]')
    why = {"extra_detection": ~lacks & more, "multiline_param": multiline, "generated_suppression": lacks & ~more & same & ~multiline}
    explained = why["extra_detection"] | why["multiline_param"] | why["generated_suppression"]
    unexplained = F.raise_error(F.concat(lit("no valid exclusion mechanism: "), col("base_snippet_id"))).cast("boolean")
    leaves = {
        "scoring_gate.total": count_if(held),
        "scoring_gate.exact": count_if(held & (status == "reproduced")),
        "scoring_gate.exact.percent": share(count_if(held & (status == "reproduced")), count_if(held)),
        "scoring_gate.excluded.total": count_if(F.when(excluded & ~explained, unexplained).otherwise(excluded)),
        "scoring_gate.fixture_fixes": count_if(held & (status == "fixture_fix")),
        "test.excluded_label_incidences": total(F.when((col("split") == "test") & (status == "excluded"), F.size("target_checks"))),
    }
    leaves |= {f"scoring_gate.excluded.mechanism.{k}": count_if(excluded & c) for k, c in why.items()}
    for s in ("validation", "test"):
        leaves |= {f"scoring_gate.excluded.{s}": count_if(excluded & (col("split") == s)), f"scored.{s}": count_if((col("split") == s) & scored)}
    for k, i in CHECK_IDS.items():
        mine = (col("split") == "test") & F.array_contains("target_checks", k)
        kept = count_if(mine & scored)
        leaves |= {f"test.check.{i}.original_support": count_if(mine), f"test.check.{i}.retained_support": kept, f"test.check.{i}.excluded_incidence": count_if(mine) - kept, f"test.check.{i}.retained_percent": share(kept, count_if(mine))}
    train = col("split") == "train"
    off = train & (status != "reproduced")
    late, long_ = off & ~col("length_excluded"), off & col("length_excluded")
    found = lambda c: total(F.when(c, F.size(extra)))
    leaves |= {
        "training.exact": count_if(train & (status == "reproduced")),
        "training.mismatch.total": count_if(off),
        "training.missing_target.total": count_if(off & lacks),
        "training.missing_only": count_if(off & lacks & ~more),
        "training.missing_and_extra": count_if(off & lacks & more),
        "training.extra_only": count_if(off & ~lacks & more),
        "training.extra_bearing_snippets": count_if(off & more),
        "training.extra_findings": found(off),
        "training.length_excluded_extra_only": count_if(long_ & ~lacks & more),
        "training.length_excluded_extra_findings": found(long_ & ~lacks),
        "training.post_length.extra_only": count_if(late & ~lacks & more),
        "training.post_length.extra_bearing_snippets": count_if(late & more),
        "training.post_length.affected_rows": total(F.when(late & more, F.size("task_types"))),
        "training.post_length.omitted_findings": found(late),
        "training.extra_bearing.reference_qc_overlap": count_if(off & more & (col("reference_qc.correction_status") != "accepted")),
    }
    out.add("study", {f"oracle.{k}": v for k, v in leaves.items()})
    hits = lambda k: F.size(F.filter(extra, lambda x: x == k))
    each = {i: total(F.when(off, hits(k))) for k, i in CHECK_IDS.items()}
    out.add("study", {f"oracle.training.extra_findings.check.{i}": F.when(n > 0, n) for i, n in each.items()}, optional=True)


def serializer(out: Leaves) -> None:
    """Parsing, skipped and truncated summaries, and the audit of a sample."""
    s, audit = (lambda c: col(f"serializer.{c}")), (lambda c: col(f"serializer_audit.{c}"))
    some, sampled = s("excluded_construct_count") > 0, col("serializer_audit").isNotNull()
    closed = sampled & audit("closure_scored")
    violated = closed & is_true("violation_in_closure")
    skipped = s("summary_status") == "skipped"
    leaves = {
        "corpus.parse_failures": count_if(~s("parse_ok")),
        "excluded_constructs.count": count_if(some),
        "excluded_constructs.percent": share(count_if(some), F.count("*")),
        "summary_skip.total": count_if(skipped),
        "summary_skip.overall_percent": share(count_if(skipped), F.count("*")),
        "audit.coverage_pool": count_if("serializer_audit_stage1_pool_member"),
        "audit.sample": count_if(sampled),
        "audit.relevant_omissions": count_if(is_true("serializer_audit.relevant_omission")),
        "audit.rows_with_notes": count_if(sampled & audit("has_note")),
        "audit.rows_with_known_lossiness": count_if(sampled & (F.size(audit("known_loss_categories")) > 0)),
        "audit.closure_violation.count": count_if(violated),
        "audit.closure_violation.denominator": count_if(closed),
        "audit.closure_violation.percent": share(count_if(violated), count_if(closed)),
        "audit.closure_violation.oracle_excluded": count_if(sampled) - count_if(closed),
    }
    for p in SPLITS:
        here = col("split") == p
        cut = count_if(here & (s("summary_status") == "present_truncated"))
        leaves |= {f"summary_skip.{p}.count": count_if(here & skipped), f"summary_truncation.{p}.count": cut, f"summary_truncation.{p}.percent": share(cut, count_if(here))}
    out.add("study", {f"serializer.{k}": v for k, v in leaves.items()})


def repositories(out: Leaves) -> None:
    """Repository groups that splits share, over one row a group: (train, test, scored) rows of it."""
    shared = (col("train") > 0) & (col("scored") > 0)
    out.add("groups", {
        "repository.total": F.count("*"),
        "repository.train_test_overlap.full_split": count_if((col("train") > 0) & (col("test") > 0)),
        "repository.scored_files_overlapping_train": total(F.when(shared, col("scored"))),
        "repository.scored_repositories_overlapping_train": count_if(shared),
        "repository.scored_test.total": count_if(col("scored") > 0),
        "repository.scored_groups_with_two_files": count_if(col("scored") == 2),
        "repository.scored_files_per_duplicate_group": one_value(F.when(col("scored") > 1, col("scored")), "files of a scored duplicate group").cast("long"),
    })


def metadata(out: Leaves) -> None:
    """Architecture and verification, over the metadata's one row."""
    first = lambda path: F.first(col(path))
    a, r, t = "architecture", "reference_comparison", "training_path"
    short = lambda c, names: F.first(F.coalesce(*[F.when(col(c) == k, v) for k, v in names.items()], col(c)))
    same = ("parameter_count", "layers", "context_length", "weight_tied", "key_value_heads", "query_heads_per_key_value_head")
    leaves = {f"architecture.{k}": first(f"{a}.{k}") for k in same} | {
        "architecture.hidden_size": first(f"{a}.embedding_dimension"),
        "architecture.attention_heads": first(f"{a}.query_heads"),
        "architecture.feed_forward_size": first(f"{a}.feed_forward_dimension"),
        "architecture.vocabulary_size": first(f"{a}.vocabulary_size"),
        "architecture.compute_dtype": short(f"{a}.compute_dtype", {"bfloat16": "BF16"}),
        "architecture.rmsnorm_dtype": short(f"{a}.rmsnorm_dtype", {"float32": "FP32"}),
        "verification.scored_positions": first(f"{r}.scored_position_count"),
        "verification.maximum_opposing_margin_threshold": first(f"{r}.margin_threshold"),
        "verification.forward_tolerance": first(f"{r}.null_forward_tolerance"),
        "verification.hard_gates.passed": F.first(col(f"{r}.tokenizer_exact").cast("long") + (col(f"{r}.systematic_disagreements_fp32") == 0).cast("long")),
    }
    leaves |= {f"verification.{k}": first(f"{r}.{k}") for k in ("prompt_count", "tokenizer_exact", "chat_template_match", "chat_template_first_divergence", "generation_exact")}
    for p in ("fp32", "bf16"):
        leaves |= {f"verification.{p}_reference.{k}": first(f"{r}.{c}_{p}") for k, c in (("next_token_agreement", "next_token_agreement"), ("raw_disagreements", "disagreements"), ("systematic_disagreements", "systematic_disagreements"))}
    leaves |= {f"verification.fp32_reference.{k}_absolute_logit_difference": first(f"{r}.{k}_absolute_logit_difference") for k in ("maximum", "mean")}
    leaves |= {f"verification.{i}.status": first(f"{r}.{c}_test.status") for i, c in (("cached_generation", "cached_generation"), ("sdpa_manual_attention", "sdpa_manual"), ("loss_masking", "loss_masking"))}
    path = ["steps", "examples", *[f"{x}_relative_loss_divergence" for x in ("mean", "maximum")], *[f"{x}_{y}" for x in ("final_loss", "validation_macro_f1") for y in ("scratch", "reference")]]
    leaves |= {f"verification.training_path.{k}": first(f"{t}.{k}") for k in path}
    notes = lambda k: F.first(F.get(F.filter("operator_log_observations", lambda o: o["id"] == k), lit(0))["approximate_value"])
    leaves |= {f"training.operator.{i}": notes(k) for i, k in (("device_memory_c0_gb", "device_memory_c0_gb"), ("device_memory_syntax_gb", "device_memory_syntax_gb"), ("provider_credits", "provider_credits_total"))}
    out.add("metadata", leaves)


def accounting(out: Leaves) -> None:
    """Slots and supervised tokens by pool, over the metadata's token accounting."""
    of = lambda c, p: (col("condition") == c) & (col("pool") == p)
    main, aux = of("C2", "main"), of("C2", "syntax_auxiliary")
    slots = lambda c: one_value(F.when(c, col("slot_count")), "slots").cast("long")
    run = uniform([total(F.when((col("condition") == c) & (col("seed") == s), col("slot_count"))) for c, s in product(study.TUNED, study.SEEDS)], "slots of a run").cast("long")
    mean = lambda c: F.avg(F.when(c, col("supervised_tokens")))
    pools = {"c2.main": main, "c2.auxiliary": aux, "c2_control.main": of("C2-control", "main"), "c2_control.duplicated": of("C2-control", "duplicated_main_control")}
    part = lambda a, b: mean(pools[a]) / (mean(pools[b]) + mean(pools[a])) * 100
    leaves = {"slots.total_per_run": run, "slots.c2_main": slots(main), "slots.c2_auxiliary": slots(aux), "slots.main_ratio": slots(main) / run, "slots.auxiliary_ratio": slots(aux) / run}
    leaves |= {f"supervised_decomposition.{k}_tokens_m": mean(c) / 1e6 for k, c in pools.items()}
    leaves |= {"supervised_decomposition.c2.auxiliary_percent": part("c2.auxiliary", "c2.main"), "supervised_decomposition.c2_control.duplicated_percent": part("c2_control.duplicated", "c2_control.main")}
    out.add("accounting", {f"training.{k}": v for k, v in leaves.items()})


def run_results(out: Leaves) -> None:
    """Tokens, time, memory and selected steps of the tuned runs, over run results."""
    tuned = col("condition").isin(study.TUNED)
    m, sel = (lambda k: col(f"metrics.compute.{k}")), (lambda k: col(f"metrics.checkpoint_selection.{k}"))
    at = lambda c, s, k: F.max(F.when((col("condition") == c) & (col("seed") == s), m(k)))
    mean = lambda c, x: F.avg(F.when(col("condition") == c, x))
    over = lambda a, b, k: (mean(a, m(k)) / mean(b, m(k)) - 1) * 100
    by_seed = lambda a, b, k: [(at(a, s, k) / at(b, s, k) - 1) * 100 for s in study.SEEDS]
    most = lambda xs: F.greatest(*xs)
    leaves = {"runs.fine_tuned": count_if(tuned), "training_set_sizes": F.count_distinct(F.when(tuned, col("metrics.provenance.data_fraction"))), "length.retained_truncations": total(F.when(tuned, col("metrics.length.realized_truncation")))}
    for c, k in product(study.TUNED, ("total_tokens", "supervised_tokens")):
        leaves[f"seed_42.{CONDITION_IDS[c]}.{k}_m"] = at(c, 42, k) / 1e6
    for k in ("total_tokens", "supervised_tokens"):
        moved = most([F.abs(at(c, s, k) - at(c, 42, k)) / at(c, 42, k) * 100 for c, s in product(study.TUNED, (43, 44))])
        leaves[f"seed_variation.{k}.maximum_percent"] = F.ceil(moved * 10) / 10
    leaves |= {
        "budget_match.c2.supervised_max_deviation_percent": most([F.abs(x) for x in by_seed("C2", "C1", "supervised_tokens")]),
        "budget_match.c2.total_deficit_min_percent": F.least(*[-x for x in by_seed("C2", "C1", "total_tokens")]),
        "budget_match.c2.total_deficit_max_percent": most([-x for x in by_seed("C2", "C1", "total_tokens")]),
        "budget_match.c2_control.supervised_max_deviation_percent": most([F.abs(x) for x in by_seed("C2-control", "C1", "supervised_tokens")]),
        "budget_match.c2_control.total_max_deviation_percent": most([F.abs(x) for x in by_seed("C2-control", "C1", "total_tokens")]),
        "budget_match.c2_control.total_over_c2_percent": over("C2-control", "C2", "total_tokens"),
        "sweep.training_hours": F.sum(F.when(tuned, m("wall_clock_train_s"))) / 3600,
        "sweep.end_to_end_hours": F.sum(F.when(tuned, m("wall_clock_total_s"))) / 3600,
    }
    for i, k in (("total_tokens", "total_tokens"), ("training_time", "wall_clock_train_s"), ("end_to_end_time", "wall_clock_total_s"), ("peak_memory", "peak_allocated_gpu_memory_gib")):
        leaves[f"cost.c1_over_c0.{i}_percent"] = over("C1", "C0", k)
    rest = m("wall_clock_total_s") - m("wall_clock_train_s")
    minutes = [mean(c, rest) / 60 for c in study.TUNED]
    leaves |= {"end_to_end_nontraining_minutes.minimum": F.least(*minutes), "end_to_end_nontraining_minutes.maximum": most(minutes)}
    outputs = F.first(col("full_test_outputs"))
    leaves |= {"throughput.c0.seconds_per_output": mean("C0", rest) / outputs, "throughput.syntax.seconds_per_output": F.avg(F.when(col("condition").isin(SYNTAX), rest)) / outputs}
    final = F.first(col("max_steps"))
    chosen = F.when(tuned, sel("selected_step"))
    early = F.when(chosen != col("max_steps"), chosen)
    leaves |= {
        "checkpoint_selection.final_step": final,
        "checkpoint_selection.final_count": count_if(chosen == col("max_steps")),
        "checkpoint_selection.alternate_step": one_value(early, "the alternate step").cast("long"),
        "checkpoint_selection.alternate_count": F.count(early),
    }
    leaves |= {f"checkpoint_selection.best_composite.{CONDITION_IDS[c]}": mean(c, sel("best_composite")) for c in study.TUNED}
    out.add("results", {f"training.{k}": v for k, v in leaves.items()})
    out.add("traces", {"training.checkpoint_selection.evaluations_per_run": one_value(col("n"), "evaluations of a run").cast("long")})


def configuration(out: Leaves) -> None:
    """The training profile and the run matrix, over the configuration's one row: profile, conditions (array)."""
    p = lambda k: F.first(col(f"profile.{k}"))
    same = ["max_steps", "micro_batch_size", "effective_batch_size", "learning_rate", "epsilon", "weight_decay", "warmup_ratio", "minimum_learning_rate_ratio", "maximum_gradient_norm", "activation_checkpointing"]
    caps = "profile.generation_max_new_tokens"
    of = lambda k: F.filter("conditions", lambda c: c["kind"] == k)
    named = lambda n: F.first(F.size(F.get(F.filter("conditions", lambda c: c["name"] == n), lit(0))["seeds"])).cast("long")
    seeds = lambda k: F.array_sort(F.array_distinct(F.flatten(F.transform(of(k), lambda c: c["seeds"]))))
    only = lambda xs, what: F.first(F.when(F.size(xs) == 1, F.get(xs, lit(0))).otherwise(F.raise_error(lit(f"{what} must have one common value")).cast("long")))
    leaves = {f"profile.{k}": p(k) for k in same} | {
        "length.allowed_max_length": p("allowed_max_length"),
        "profile.gradient_accumulation_steps": p("grad_accum_steps"),
        "profile.beta_1": F.first(F.get("profile.betas", lit(0))),
        "profile.beta_2": F.first(F.get("profile.betas", lit(1))),
        "checkpoint_selection.cadence_steps": p("checkpoint_every_steps"),
        "profile.generation_max_new_tokens.rule_identification": F.first(col(f"{caps}.rule_identification")),
        "profile.generation_max_new_tokens.generative_tasks": only(F.array_distinct(F.array(*[col(f"{caps}.{t}") for t in ("explanation", *REPAIRS)])), "generative caps"),
        "composite.metric_count": F.max(lit(3)),
        "conditions.fine_tuned": F.first(F.size(of("fine_tuned"))).cast("long"),
        "seeds.count": F.first(F.size(seeds("fine_tuned"))).cast("long"),
        "zero_shot.executions.raw": named("zero-shot-raw"),
        "zero_shot.executions.syntax": named("zero-shot-syntax"),
        "zero_shot.provenance_seed": only(seeds("zero_shot"), "zero-shot seed"),
    }
    leaves |= {f"seed.{s}": F.first(F.get(seeds("fine_tuned"), lit(i))) for i, s in enumerate(study.SEEDS)}
    out.add("config", {f"training.{k}": v for k, v in leaves.items()})


def contributions(out: Leaves) -> None:
    """Training pools and lengths before the exclusion, over the contributions of study rows (with max_length)."""
    of = lambda c, p: (col("condition") == c) & (col("pool") == p)
    aux, control = of("C2", "syntax_auxiliary"), of("C2-control", "duplicated_main_control")
    rows = lambda c: total(F.when(c, col("multiplicity")))
    kept = ~col("length_excluded")
    long_ = col("condition").isin(SYNTAX) & (col("pool") == "main") & (col("total_tokens") > col("max_length"))
    each = lambda t: uniform([rows(long_ & (col("condition") == c) & (col("task_type") == t)) for c in SYNTAX], f"long {t} rows").cast("long")
    two_digits = lambda x: F.round(x / F.pow(lit(10.0), F.floor(F.log10(x)) - 1)) * F.pow(lit(10.0), F.floor(F.log10(x)) - 1)
    longest = lambda c: two_digits(F.max(F.when(of(c, "main"), col("total_tokens")))).cast("long")
    out.add("contributions", {f"training.{k}": v for k, v in {
        "pool.syntax.pre_exclusion_rows": rows(aux),
        "pool.syntax.unusable_exclusions": F.first(col("train_rows")) - rows(aux),
        "pool.syntax.post_length_rows": rows(aux & kept),
        "pool.control.pre_exclusion_rows": rows(control),
        "pool.control.distinct_examples": count_if(control),
        "pool.control.distinct_base_files": F.count_distinct(F.when(control, col("base_snippet_id"))),
        "pool.control.post_length_rows": rows(control & kept),
        "length.pre_exclusion.over_budget_rows": rows(long_),
        "length.pre_exclusion.over_budget_correction_per_syntax_condition": each("correction"),
        "length.pre_exclusion.over_budget_joint_per_syntax_condition": each("joint"),
        "length.pre_exclusion.prompt_only_over_budget": rows(col("condition").isin(SYNTAX) & (col("pool") == "main") & (col("prompt_tokens") > col("max_length"))),
        "length.pre_exclusion.syntax_max_approx": longest("C1"),
        "length.pre_exclusion.c0_max_approx": longest("C0"),
    }.items()})
    out.add("lengths", {f"training.pool.response_tokens_p50.{i}": F.max(F.when(of(c, p), col("p50"))) for i, c, p in (("main", "C1", "main"), ("syntax_auxiliary", "C2", "syntax_auxiliary"))})


def run_records(out: Leaves) -> None:
    """Labels, builds, regressions, caps and similarity, over scored records."""
    rule, repair = col("task_type") == "rule_identification", col("task_type").isin(REPAIRS)
    tuned = col("condition").isin(study.TUNED)
    cell = lambda c, t: (col("condition") == c) & (col("task_type") == t)
    fixed = is_true("outcome.overall_fixed")
    leaves = {}
    for c in study.CONDITIONS:
        mine, pre = rule & (col("condition") == c), f"run.label_normalization.{CONDITION_IDS[c]}"
        bad, all_ = total(F.when(mine, col("rejected_label_count"))), total(F.when(mine, col("n_emitted")))
        leaves |= {f"{pre}.rejected": bad, f"{pre}.emitted_members": all_}
        if c in study.TUNED:
            leaves[f"{pre}.failure_percent"] = F.coalesce(share(bad, all_), lit(0.0))
        else:
            leaves[f"{pre}.no_recognized_array"] = count_if(mine & (col("normalization_status") == "no_recognized_array"))
    leaves["run.fix_outputs.load_degraded"] = count_if(repair & (col("outcome.output_tool_status") == "load_degraded"))
    leaves["run.scored_outputs.per_fine_tuned_condition_task"] = uniform([count_if(cell(c, t)) for c, t in product(study.TUNED, study.TASKS)], "records of a condition and task").cast("long")
    for t, s in product(REPAIRS, ("NA", "OK", "FAIL")):
        rates = [share(count_if(cell(c, t) & (col("outcome.build_status") == s)), count_if(cell(c, t))) for c in study.TUNED]
        leaves |= {f"run.build.{t}.{s.lower()}.minimum_percent": F.least(*rates), f"run.build.{t}.{s.lower()}.maximum_percent": F.greatest(*rates)}
    cells = [cell(c, t) for c, t in product(study.TUNED, REPAIRS)]
    for k in ("studied", "enabled"):
        leaves[f"sensitivity.regression.{k}.maximum_count"] = F.greatest(*[count_if(x & is_true(f"outcome.{k}_regression")) for x in cells])
    leaves["sensitivity.regression.studied.maximum_percent"] = share(leaves["sensitivity.regression.studied.maximum_count"], uniform([count_if(x) for x in cells], "repair records of a cell"))
    ranges = []
    for t in REPAIRS:
        capped = [count_if(cell(c, t) & (col("retokenized_response_token_proxy") >= col(f"cap_{t}"))) for c in study.TUNED]
        rates = [share(n, count_if(cell(c, t))) for n, c in zip(capped, study.TUNED)]
        for w, f in (("minimum", F.least), ("maximum", F.greatest)):
            leaves |= {f"sensitivity.response_cap_proxy.{t}.{w}_percent": f(*rates), f"sensitivity.response_cap_proxy.{t}.{w}_count": f(*capped)}
        ranges.append(F.greatest(*rates) - F.least(*rates))
    leaves["sensitivity.response_cap_proxy.per_condition_rate_range_max_points"] = F.bround(F.greatest(*ranges)).cast("long")
    won = tuned & repair & fixed
    close = won & col("sensitivity_class").isNotNull()
    rate = lambda c: share(count_if(close & cell(c, "joint")), count_if(cell(c, "joint")))
    e = "sensitivity.extracted_code"
    leaves |= {
        f"{e}.scored_fix_successes": count_if(won),
        f"{e}.low_similarity_outputs": count_if(close),
        f"{e}.low_similarity_shared_function": count_if(close & (col("sensitivity_class") == "same_file_truncated")),
        f"{e}.low_similarity_package_only": count_if(close & (col("sensitivity_class") == "same_pkg_no_shared_func")),
    }
    leaves |= {f"{e}.condition.{CONDITION_IDS[c]}": count_if(close & (col("condition") == c)) for c in study.TUNED}
    for a, b in (("C1", "C0"), ("C2", "C1"), ("C2", "C2-control")):
        leaves[f"{e}.adjustment.{CONDITION_IDS[a]}_minus_{CONDITION_IDS[b]}.maximum_points"] = rate(a) - rate(b)
    task = lambda t: share(count_if(cell("C1", t) & fixed), count_if(cell("C1", t)))
    leaves["sensitivity.task_rate.c1.correction_minus_joint.approx_points"] = F.bround(task("correction") - task("joint")).cast("long")
    several = rule & (F.size("gold") > 1)
    leaves["sensitivity.multilabel.rule_exact.all_conditions_percent"] = share(count_if(several & col("exact_match")), count_if(several))
    b = cell("C2", "joint") & (col("outcome.category") == "B")
    leaves["section_8_10.category_b.runs"] = count_if(b)
    for s in study.SEEDS:
        for c in ("C0", "C1"):
            leaves[f"rq1.joint.{CONDITION_IDS[c]}.seed_{s}.percent"] = share(count_if(cell(c, "joint") & (col("seed") == s) & fixed), count_if(cell(c, "joint") & (col("seed") == s)))
        leaves[f"rq1.joint.c1_minus_c0.seed_{s}"] = leaves[f"rq1.joint.c1.seed_{s}.percent"] - leaves[f"rq1.joint.c0.seed_{s}.percent"]
        exact = share(count_if(cell("C0", "rule_identification") & (col("seed") == s) & col("exact_match")), count_if(cell("C0", "rule_identification") & (col("seed") == s)))
        leaves[f"rq1.rule_id_exact_match.c0.seed_{s}.percent"] = exact
    joint = {(c, s): share(count_if(cell(c, "joint") & (col("seed") == s) & fixed), count_if(cell(c, "joint") & (col("seed") == s))) for c, s in product(study.TUNED, study.SEEDS)}
    mean = lambda xs: sum(xs[1:], xs[0]) / len(xs)

    def spread(xs: list[Column]) -> Column:
        return F.sqrt(sum(((x - mean(xs)) * (x - mean(xs)) for x in xs[1:]), (xs[0] - mean(xs)) * (xs[0] - mean(xs))) / (len(xs) - 1))

    for a, b in PAIRS:
        moved = [joint[a, s] - joint[b, s] for s in study.SEEDS]
        pre = f"{'rq1' if b == 'C0' else 'rq2'}.joint.{CONDITION_IDS[a]}_minus_{CONDITION_IDS[b]}"
        if b != "C0":
            leaves |= {f"{pre}.seed_{s}": x for s, x in zip(study.SEEDS, moved)}
        if a != "C2-control":
            leaves[f"{pre}.seed_sd"] = spread(moved)
    base = [joint["C0", s] for s in study.SEEDS]
    leaves["rq1.joint.relative_to_c0.percent"] = (mean([joint["C1", s] for s in study.SEEDS]) - mean(base)) / mean(base) * 100
    by_seed = [leaves[f"rq1.rule_id_exact_match.c0.seed_{s}.percent"] for s in study.SEEDS]
    leaves["rq1.rule_id_exact_match.c0.seed_range_points"] = F.greatest(*by_seed) - F.least(*by_seed)
    out.add("records", leaves)


def files(out: Leaves) -> None:
    """What a snippet's records say together, over one row a snippet (see ``frames``)."""
    n = F.count("*")
    better, worse = count_if(~col("raw") & col("syntax")), count_if(col("raw") & ~col("syntax"))
    z = "section_8_10.zero_shot_transition"
    only = F.size(F.filter("c2_only", lambda x: x))
    out.add("files", {
        "section_8_10.c0_all_seed_correct.count": count_if("c0_all"),
        "section_8_10.c0_all_seed_correct.percent": share(count_if("c0_all"), n),
        "section_8_10.c2_only.any_seed.files": count_if(only > 0),
        "section_8_10.c2_only.at_least_two_seeds.files": count_if(only >= 2),
        "section_8_10.category_b.files": count_if("category_b"),
        f"{z}.changed": better + worse,
        f"{z}.favor_syntax": better,
        f"{z}.favor_raw": worse,
        f"{z}.net_files": better - worse,
        f"{z}.net_points": share(better - worse, n),
        "sensitivity.extracted_code.unique_snippets": count_if("low_similarity"),
        "sensitivity.summary_stratum.skipped.files": count_if("skipped"),
        "rq1.nonzero_seed_averaged_contrast.files": count_if(col("c0_fixes") != col("c1_fixes")),
        "rq1.discordance.minimum_rate": F.least(*[share(count_if(F.get("differs", lit(i))), n, 1.0) for i in range(len(study.SEEDS))]),
        "rq1.discordance.maximum_rate": F.greatest(*[share(count_if(F.get("differs", lit(i))), n, 1.0) for i in range(len(study.SEEDS))]),
        "oracle.scored_set.shared_across_cells": F.bool_and((col("records") == col("expected")) & (col("cells") == col("expected"))),
    })


def strata(out: Leaves) -> None:
    """C1's joint outcomes by summary status beside C0's of the same snippet and seed, over such pairs."""
    for s in ("present", "present_truncated"):
        mine = col("status") == s
        rate = {c: share(count_if(mine & col(c)), count_if(mine)) for c in ("c0", "c1")}
        out.add("pairs", {f"sensitivity.summary_stratum.{c}.{s}.fix_percent": r for c, r in rate.items()} | {f"sensitivity.summary_stratum.{s}.outputs": count_if(mine), f"sensitivity.summary_stratum.{s}.c1_minus_c0_points": rate["c1"] - rate["c0"]})
    out.add("pairs", {"sensitivity.summary_stratum.skipped.outputs": count_if(col("status") == "skipped")})


def prompts(out: Leaves) -> None:
    """Prompt and answer lengths, over nearest-index percentiles by condition and task (``what``: prompt or answer)."""
    at = lambda c, t, k: F.max(F.when((col("what") == "prompt") & (col("condition") == c) & (col("task_type") == t), col(k)))
    leaves = {}
    for i, c in (("c0", "C0"), ("syntax", "C1")):
        p50 = [at(c, t, "p50") for t in study.TASKS]
        leaves |= {f"joint.{i}.p50": at(c, "joint", "p50"), f"joint.{i}.max": at(c, "joint", "max"), f"task_p50.{i}.minimum": F.least(*p50), f"task_p50.{i}.maximum": F.greatest(*p50)}
    leaves["joint.syntax_median_overhead_percent"] = (at("C1", "joint", "p50") / at("C0", "joint", "p50") - 1) * 100
    out.add("prompts", {f"sensitivity.prompt.{k}": v.cast("double") for k, v in leaves.items()})
    answer = lambda t: F.max(F.when((col("what") == "answer") & (col("task_type") == t), col("p50"))).cast("double")
    out.add("prompts", {f"sensitivity.response_cap_proxy.{t}.p50": answer(t) for t in ("rule_identification", "explanation")})


def contrasts(out: Leaves) -> None:
    """Paired contrasts and their intervals, over one row a contrast (metric, a, b, point, low, high), in points."""
    of = lambda m, a, b, k: F.max(F.when((col("metric") == m) & (col("a") == a) & (col("b") == b), col(k))) * 100
    leaves = {}
    for m, a, b in CONTRASTS:
        name = f"{'rq1' if b == 'C0' else 'rq2'}.{m}.{CONDITION_IDS[a]}_minus_{CONDITION_IDS[b]}"
        leaves |= {f"{name}.{k}": of(m, a, b, k) for k in (("point",) if m == "correction" else ("point", "low", "high"))}
    out.add("contrasts", leaves)
    risk = lambda t, k: F.max(F.when(col("reference") == t, col(k)))
    names = {"correction": "correction", "rule": "rule_identification"}
    out.add("risk", {f"rq3.risk.joint_minus_{i}.{k}": risk(t, k) * 100 for (i, t), k in product(names.items(), ("point", "low", "high"))} | {"rq3.h3_supported": (risk("correction", "low") > 0) & (risk("rule_identification", "low") > 0)})
    out.add("interaction", {f"rq3.vb.c1_joint_interaction.{k}": F.first(k) for k in ("coefficient", "low", "high", "sd")})


def familiarity(out: Leaves) -> None:
    """F1 by check without tuning and for C0 (mean over seeds), over (condition, class, f1 in percent)."""
    zero = col("condition") != "C0"
    whole = lambda c: F.bround(c).cast("long")
    ends = {f"{n}.{w}_percent": whole(f(F.when(z, col("f1")))) for (n, z), (w, f) in product((("zero_shot", zero), ("c0", ~zero)), (("minimum", F.min), ("maximum", F.max)))}
    out.add("familiarity", {f"sensitivity.familiarity.{k}": v for k, v in (ends | {"zero_shot.overall_approx_percent": whole(F.avg(F.when(zero, col("f1"))))}).items()})


#: Pairs of conditions whose joint rates are compared by seed, and the contrasts with intervals, by metric.
PAIRS = [("C1", "C0"), ("C2-control", "C1"), ("C2", "C1"), ("C2", "C2-control")]
CONTRASTS = [("rule_id_macro_f1", "C1", "C0"), ("joint", "C2-control", "C1"), *[(m, "C2", b) for m in ("joint", "rule_id_exact_match", "rule_id_macro_f1", "correction") for b in ("C1", "C2-control")]]
# Bootstrap seeds of the contrasts by metric.
CONTRAST_SEEDS = {"joint": 42, "correction": 43, "rule_id_exact_match": 44, "rule_id_macro_f1": 45}


def contrast_rows(records: DataFrame, draws: int = 10_000) -> DataFrame:
    """(metric, a, b, point, low, high) of each contrast; macro-F1 by draws of the counter, the others by the published stream."""
    tasks = {"joint": "joint", "correction": "correction", "rule_id_exact_match": "rule_identification"}
    grid = study.success(records).where(col("condition").isin(study.TUNED)).groupBy("task_type", "base_snippet_id", "seed").agg(*[F.max(F.when(col("condition") == c, col("success"))).alias(CONDITION_IDS[c]) for c in study.TUNED])
    paired = [(m, a, b) for m, a, b in CONTRASTS if m in tasks]
    each = F.array(*[F.struct(lit(m).alias("metric"), lit(a).alias("a"), lit(b).alias("b"), lit(tasks[m]).alias("t"), lit(CONTRAST_SEEDS[m]).alias("seed"), (col(CONDITION_IDS[a]) - col(CONDITION_IDS[b])).alias("d")) for m, a, b in paired])
    long = grid.select("task_type", "base_snippet_id", F.explode(each).alias("e")).where("e.t = task_type").groupBy("e.metric", "e.a", "e.b", "e.seed", "base_snippet_id").agg(F.avg("e.d").alias("d"))
    out = resample.stream_intervals(long, ["metric", "a", "b", "seed"], "base_snippet_id", "d", draws).select("metric", "a", "b", "point", "low", "high")
    rule = records.where(col("task_type") == "rule_identification")
    for m, a, b in CONTRASTS:
        if m not in tasks:
            one = resample.macro_f1_interval(rule, "base_snippet_id", "seed", "condition", a, b, "pred", "gold", study.CHECKS, draws, CONTRAST_SEEDS[m])
            out = out.unionByName(one.select(lit(m).alias("metric"), lit(a).alias("a"), lit(b).alias("b"), "point", "low", "high"))
    return out


FAMILIES = [contrasts, familiarity, dataset, reference_qc, oracle, serializer, repositories, metadata, accounting, run_results, configuration, contributions, run_records, files, strata, prompts]


def registry(families: list = FAMILIES) -> Leaves:
    out = Leaves()
    for f in families:
        f(out)
    return out


def frames(bundle: Bundle, caps: dict[str, int] | None = None, draws: int = 10_000) -> dict[str, DataFrame]:
    """The frames of a loaded bundle (with metadata)."""
    spark, rows, records = bundle.records.sparkSession, bundle.study_rows, bundle.scored
    profile = next(iter(bundle.config["profiles"].values()))
    caps = caps or {t: profile["generation_max_new_tokens"][t] for t in REPAIRS}
    conditions = [{"name": n, "kind": c["kind"], "seeds": list(c["seeds"])} for n, c in bundle.config["conditions"].items()]
    kind = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    ddl = lambda v: "struct<" + ", ".join(f"{k}: {ddl(x)}" for k, x in v.items()) + ">" if isinstance(v, dict) else f"array<{ddl(v[0])}>" if isinstance(v, list | tuple) else kind[type(v)]
    config = spark.createDataFrame([(profile, conditions)], f"profile {ddl(profile)}, conditions array<struct<name: string, kind: string, seeds: array<bigint>>>")
    n = lambda c: count_if(c)
    test, kept = col("split") == "test", (col("oracle.status") != "excluded") & ~col("quarantined")
    given = rows.select("base_snippet_id", "length_excluded", F.explode("training_contributions").alias("c")).select("base_snippet_id", "length_excluded", "c.*")
    counts = rows.agg(n(col("split") == "train").alias("train_rows"), (n(test) * len(study.TASKS)).alias("full_test_outputs"))
    meta = spark.createDataFrame([bundle.metadata], f"{METADATA_DDL}")
    s = lambda c, t, x, seed=None: F.when((col("condition") == c) & (col("task_type") == t) & (lit(True) if seed is None else col("seed") == seed), x)
    exact = lambda c, seed: F.coalesce(F.bool_or(s(c, "rule_identification", col("exact_match"), seed)), lit(False))
    every = lambda c, t, x: F.coalesce(F.bool_or(s(c, t, x)), lit(False))
    close = col("condition").isin(study.TUNED) & col("task_type").isin(REPAIRS) & is_true("outcome.overall_fixed") & col("sensitivity_class").isNotNull()
    joint = lambda c, seed: F.coalesce(F.bool_or(s(c, "joint", col("outcome.overall_fixed"), seed)), lit(False))
    runs = sum(len(c["seeds"]) for c in bundle.config["conditions"].values())
    only = [exact("C2", x) & ~exact("C0", x) & ~exact("C1", x) for x in study.SEEDS]
    all_c0 = exact("C0", study.SEEDS[0])
    for x in study.SEEDS[1:]:
        all_c0 = all_c0 & exact("C0", x)
    snippets = records.groupBy("base_snippet_id").agg(
        all_c0.alias("c0_all"), F.array(*only).alias("c2_only"), every("C2", "joint", col("outcome.category") == "B").alias("category_b"), every("zero-shot-raw", "joint", col("outcome.overall_fixed")).alias("raw"),
        every("zero-shot-syntax", "joint", col("outcome.overall_fixed")).alias("syntax"), F.coalesce(F.bool_or(close), lit(False)).alias("low_similarity"), every("C1", "joint", col("summary_status") == "skipped").alias("skipped"),
        n(s("C0", "joint", col("outcome.overall_fixed"))).alias("c0_fixes"), n(s("C1", "joint", col("outcome.overall_fixed"))).alias("c1_fixes"),
        F.array(*[joint("C0", x) != joint("C1", x) for x in study.SEEDS]).alias("differs"), F.count("*").alias("records"),
        F.size(F.collect_set(F.struct("condition", "seed", "task_type"))).alias("cells"), lit(runs * len(study.TASKS)).alias("expected"),
    )
    pairs = records.where("task_type = 'joint' and condition in ('C0', 'C1')").groupBy("base_snippet_id", "seed").agg(
        F.max(F.when(col("condition") == "C1", col("summary_status"))).alias("status"), every("C0", "joint", col("outcome.overall_fixed")).alias("c0"), every("C1", "joint", col("outcome.overall_fixed")).alias("c1")
    )
    prompt = stats.nearest_index(records, ["condition", "task_type"], "prompt_tokens").select(lit("prompt").alias("what"), "condition", "task_type", "p50", "max")
    answer = stats.nearest_index(records.where(col("condition").isin(study.TUNED)), ["task_type"], "retokenized_response_token_proxy").select(lit("answer").alias("what"), lit("").alias("condition"), "task_type", "p50", "max")
    lengths = stats.nearest_rank(given.where(~col("length_excluded")).withColumn("_copy", F.explode(F.sequence(lit(1), col("multiplicity")))), ["condition", "pool"], "response_tokens").select("condition", "pool", "p50")
    return {
        "study": rows,
        "groups": rows.groupBy("repository_group_id").agg(n(col("split") == "train").alias("train"), n(test).alias("test"), n(test & kept).alias("scored")),
        "metadata": meta,
        "accounting": meta.select(F.explode("token_accounting").alias("a")).select("a.*"),
        "results": bundle.results.crossJoin(counts.select("full_test_outputs")).withColumn("max_steps", lit(profile["max_steps"]).cast("long")),
        "traces": bundle.traces.where(col("condition").isin(study.TUNED)).groupBy("condition", "seed").agg(F.count("*").alias("n")),
        "config": config,
        "contributions": given.crossJoin(counts.select("train_rows")).withColumn("max_length", lit(profile["allowed_max_length"])),
        "lengths": lengths,
        "records": records.select("*", *[lit(v).alias(f"cap_{t}") for t, v in caps.items()]),
        "files": snippets,
        "pairs": pairs,
        "prompts": prompt.unionByName(answer),
        "contrasts": contrast_rows(records, draws),
        "risk": study.rq3_contrasts(records, draws),
        "interaction": spark.createDataFrame([mixed.interaction(study.success(records), "base_snippet_id", "condition", "task_type", "success", ("C0", "C1"), ("correction", "joint"))]),
        "familiarity": study.table_8_9(records),
    }


_STATUS = "struct<status: string, evidence_class: string>"
METADATA_DDL = f"""architecture struct<vocabulary_size: bigint, context_length: bigint, embedding_dimension: bigint, query_heads: bigint, key_value_heads: bigint, query_heads_per_key_value_head: bigint, layers: bigint, feed_forward_dimension: bigint, rope_base: double, parameter_count: bigint, weight_tied: boolean, compute_dtype: string, rmsnorm_dtype: string>,
reference_comparison struct<prompt_count: bigint, scored_position_count: bigint, tokenizer_exact: boolean, chat_template_match: boolean, chat_template_first_divergence: bigint, generation_exact: boolean, generation_first_divergence: bigint, next_token_agreement_fp32: double, disagreements_fp32: bigint, systematic_disagreements_fp32: bigint,
next_token_agreement_bf16: double, disagreements_bf16: bigint, systematic_disagreements_bf16: bigint, margin_threshold: double, near_tie_epsilon: double, maximum_absolute_logit_difference: double, mean_absolute_logit_difference: double, null_forward_tolerance: double, cached_generation_test: {_STATUS}, sdpa_manual_test: {_STATUS}, loss_masking_test: {_STATUS}>,
training_path struct<steps: bigint, examples: bigint, validation_examples: bigint, micro_batch_size: bigint, gradient_accumulation_steps: bigint, learning_rate: double, mean_relative_loss_divergence: double, maximum_relative_loss_divergence: double, final_loss_scratch: double, final_loss_reference: double, validation_macro_f1_scratch: double, validation_macro_f1_reference: double>,
token_accounting array<struct<condition: string, seed: bigint, pool: string, slot_count: bigint, forwarded_tokens: bigint, supervised_tokens: bigint, evidence_class: string>>,
operator_log_observations array<struct<id: string, approximate_value: double, unit: string, evidence_class: string, approximate: boolean>>"""
