"""Schemas of the domain's records, in writer order."""

from __future__ import annotations

TURNS = "array<struct<speaker:string,text:string>>"

SCHEMAS = {
    "suitability_record": f"id bigint, topic string, difficulty string, fact_pattern string, question string, answer string, compliant boolean, analysis string, borderline_factors array<string>, likely_outcome string, conversation {TURNS}, legal_assessment struct<issues_identified:string,severity:string,analysis:string>, red_flag string, red_flag_indicators array<string>, regulatory_concern string, recommended_action string, correct_answer string, common_wrong_answer string, adversarial_type string",
    "manifest_case": "case_id string, year int, court string, court_name string, caption string, docket string, n_pages int, source_file string, in_original_40 boolean, url_hint string, jurisdiction string, court_level string, arm string, date_filed date, date_source string, opinion_id bigint, cluster_id bigint, cl_verdict string, cl_field string, added_by string",
    "qa": "case_id string, arm string, date_filed string, caption string, jurisdiction string, court string, court_level string, text_source string, qid string, tier string, question string, prompt string, prompt_normalized string, prompt_words int, answer string, answer_normalized string, found int, evidence string, n_sentences int, n_headings int, n_footnotes int",
    "prediction": "case_id string, qid string, arm string, jurisdiction string, court_level string, tier string, model string, model_cutoff string, served_by string, recall string, raw string, prediction string, refused int, finish string, error string, temp_dropped int, latency_s double, in_tokens int, out_tokens int, ts string",
    "judged": "case_id string, model string, arm string, date_filed string, court_level string, judge string, web int, outcome_score double, reasoning_score double, combined double, declined int, disposition_actual string, disposition_claimed string, justification string, parse_error string, error string, in_tokens int, out_tokens int, latency_s double, ts string",
    "truth": "case_id string, disposition_actual string, prevailing_party string, justification string, judge string, parse_error string, error string, ts string",
    "logprob": "case_id string, qid string, work string, arm string, date_filed string, jurisdiction string, model string, condition string, trunc_n string, n_prefix_tokens int, n_suffix_tokens int, logp_sum double, logp_per_token double, p_geomean double, min_token_logprob double, n_tokens_below_1e3 int, first_break_index int, align_warning string",
    "hotspot": "rank int, case_id string, arm string, mean_logp double, n_tokens int, char_start int, char_end int, text string",
    "generation": "dataset string, case_id bigint, model_family string, model_key string, model string, answer string",
    "rubric_score": "dataset string, case_id bigint, model string, judge string, present map<string,boolean>, evidence map<string,string>",
    "panel_judgment": "dataset string, id bigint, generator string, judge string, judge_model string, condition string, score double, rationale string, guessed_question string, valid boolean",
}
