"""Names of the modelling steps in a study's log."""

# Tool names of the modelling steps, as logged by the reference.
TOOL_CREATE_DATASET = "cmd_create_dataset"
TOOL_TREE = "cmd_rpart"
TOOL_GLM = "cmd_glmnet"
TOOL_INFERENCE = "cmd_run_inference"
