"""Schemas of stored tables and reports, as DDL."""

GROUND_TRUTH = "scan_id string, job_number string, notes string"

_FILE = (
    "filename:string,original_filename:string,raw_job:string,corrected_job:string,confidence:double,"
    "reason:string,status:string,processing_time_sec:double,method:string,error:string"
)
RUN_REPORT = (
    "batch_metadata struct<batch_id:string,total_files:bigint,successful_autofiling:bigint,manual_review_required:bigint,"
    "failed:bigint,success_rate_pct:double,hitl_rate_pct:double,total_wall_time_sec:double,parallel_speedup:double,generated_at:string>, "
    f"files array<struct<{_FILE}>>, _corrupt string"
)
#: Both dialects: absent fields are null.
METRICS = (
    "timestamp string, "
    "summary struct<total_in_batch:bigint,total_verified:bigint,passed:bigint,verification_errors:bigint,extraction_failures:bigint,"
    "total_errors:bigint,accuracy:double,verified_files:bigint,pending_files:bigint,verified_trusted_count:bigint,human_corrections:bigint,"
    "theoretical_automation:double,theoretical_auto_count:bigint,actual_accuracy:double,silent_failures:bigint,silent_failure_rate:double,"
    "total_wall_time_sec:double,avg_speed_sec:double,avg_typo_similarity:double,initial_success:bigint,initial_hitl:bigint,"
    "initial_failed:bigint,parallel_speedup:double>, "
    "tier_breakdown map<string,bigint>, error_analysis map<string,bigint>, "
    "confidence_stats struct<mean:double,min:double,max:double,low_confidence_count:bigint,sum:double,count:bigint>, "
    "method_stats map<string,struct<total:bigint,correct:bigint>>, "
    "batch_info struct<batch_id:string,ground_truth_count:bigint,total_files_processed:bigint,verified_count:bigint,avg_processing_time_sec:double,"
    "extraction_failure_count:bigint,extraction_failure_files:array<string>>, "
    "data_source struct<raw_data_path:string,enhanced_metadata:string,json_path:string>, "
    "failed_files array<struct<filename:string,expected:string,actual:string,error_type:string>>, "
    "extraction_failures array<struct<filename:string,reason:string>>, "
    "per_file_results array<struct<filename:string,expected:string,actual:string,passed:boolean,confidence:double,tier:string,processing_time_sec:double>>, "
    "_corrupt string"
)
CORRECTION = (
    "filename string, system_guess string, human_correction_ground_truth string, similarity_score double, "
    "confidence double, method_used string, batch_id string, harvested_at string"
)
EXTRACTION = (
    "filename string, original_filename string, original_path string, job_number string, confidence double, method string, "
    "meta struct<has_red_correction:boolean,error:string>, processing_time_sec double, page int, error string, status string, raw_job_number string"
)
