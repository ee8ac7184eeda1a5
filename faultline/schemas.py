"""Column lists and fixed values shared by the jobs."""

from pyspark.sql import types as T

# --- fixed values: they must equal the documented ones for results to match -----------------------
RESOLUTIONS = ["PURGE", "REPROCESS", "INVESTIGATE", "UNDEFINED"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
REQUIRED_EXCEPTION_COLUMNS = ["LOG_SEQ_NO", "EVENT_INFORMATION", "SEVERITY"]
REQUIRED_KB_COLUMNS = ["Exception_Type", "Resolution", "EVENT_INFORMATION"]
CLASS_LABELS = [
    "DatabaseError", "NetworkError", "ValidationError", "ConfigurationError", "PermissionError",
    "TimeoutError", "NullReferenceError", "ConcurrencyError", "IntegrationError",
    "BusinessLogicError", "EntityException", "UnknownError",
]
PROCESS_NAME_KEYS = ["Process Name", "PRCS_NAME", "process_name", "ProcessName"]
PROCESS_NAME_COLUMNS = ["Process_Name", "ProcessName", "PROCESS_NAME"]
STANDARD_MODULES = ["ClaimGeneration", "ClaimPricing"]
CODE_EXTENSIONS = [".cs", ".py", ".java", ".js", ".ts", ".cpp", ".c", ".h", ".sql", ".vb", ".php", ".rb", ".go"]
SKIPPED_FOLDERS = [
    "node_modules", "bin", "obj", ".git", ".vs", "__pycache__", "venv", ".venv", "packages",
    "Debug", "Release", ".idea", "build", "dist",
]
NO_CASES_TEXT = "No similar cases found in knowledge base (First occurrence or unique pattern)."
RESULT_COLUMNS = [
    "Exception_ID", "Selected_Module", "Exception_Type", "Exception_Message", "Original_Error",
    "Stack_Trace", "Resolution", "Root_Cause", "Confidence_Score", "Reasoning",
    "Similar_Past_Cases", "Suggested_Action", "Severity", "Machine_Name", "Process_Name",
    "Timestamp", "Analysis_Type", "Requires_Review", "Dedup_Group_ID", "Dedup_Count",
    "Original_Exception_IDs",
]
REVIEW_DISPLAY_COLUMNS = [
    "Module", "Exception_ID", "Process_Name", "Exception_Type", "Exception_Message", "Root_Cause",
    "Resolution", "Suggested_Action", "Confidence_Score", "Review_Reason", "User_Resolution",
    "User_Suggested_Step", "Review_Status",
]
# KB file column -> stored column; the first source present wins
KB_ALIASES = {
    "EVENT_INFORMATION": ["EVENT_INFORMATION", "Event_Information"],
    "Exception_Type": ["Exception_Type", "Exception Type", "ExceptionType", "exception_type"],
    "Exception_Message": ["Exception_Message", "Message", "ExceptionTemplate"],
    "Root_Cause": ["Root_Cause", "Root Cause", "RootCause_text", "Summary", "Explanation"],
    "Resolution": ["Resolution", "resolution"],
    "Action": ["Action", "Suggested Step", "Suggested_Action", "suggested_step"],
    "Stack_Trace": ["Stack_Trace", "StackTrace"],
}
# --- end of fixed values --------------------------------------------------------------------------

HIGH_CONFIDENCE = 80
REVIEW_THRESHOLD = 70
GOOD_MATCH = 0.70
PAGE_SIZE = 20

FRAME = T.StructType([
    T.StructField("file_path", T.StringType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("method_name", T.StringType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("package", T.StringType()),
    T.StructField("language", T.StringType()),
])

AUDIT = T.StructType([
    T.StructField("Upload_DateTime", T.TimestampNTZType()),
    T.StructField("File_Name", T.StringType()),
    T.StructField("Module", T.StringType()),
    T.StructField("Total_Records", T.LongType()),
    T.StructField("Reprocess_Count", T.LongType()),
    T.StructField("Purge_Count", T.LongType()),
    T.StructField("Investigate_Count", T.LongType()),
    T.StructField("Review_Count", T.LongType()),
    T.StructField("Avg_Confidence", T.DoubleType()),
    T.StructField("Processing_Time_Minutes", T.DoubleType()),
])
