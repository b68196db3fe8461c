"""Fixed values that results depend on."""

# Special tokens and their ids.
UNK_ID, BOS_ID, EOS_ID, PAD_ID = 0, 1, 2, 3
UNK, BOS, EOS, PAD = "<unk>", "<s>", "</s>", "<pad>"
SPECIAL_TOKENS = [UNK, BOS, EOS, PAD]
IGNORE_INDEX = -100
META_SPACE = "▁"

# Ids 4..259 of a piece table stand for the single bytes 0..255.
FIRST_BYTE_ID = 4
FIRST_PIECE_ID = 260

# Prompt templates.
INSTRUCT_NO_INPUT = "### Instruction:\n{instruction}\n\n### System:\n{output}</s>"
INSTRUCT_INPUT = (
    "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### System:\n{output}</s>"
)
PREFERENCE_PROMPT = "### Instruction: {question}\n\n### System: \n"

# Texts used when both parts of an encyclopedia or news row are blank.
BLANK_ENCYCLOPEDIA_TEXT = "百度百科"
BLANK_NEWS_TEXT = "新闻"

# Chat markers and the optional default system message.
B_INST, E_INST = "[INST]", "[/INST]"
B_SYS, E_SYS = "<<SYS>>\n", "\n<</SYS>>\n\n"
DEFAULT_SYSTEM_PROMPT = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as "
    "possible, while being safe. Your answers should not include any harmful, unethical, "
    "racist, sexist, toxic, dangerous, or illegal content. Please ensure that your responses "
    "are socially unbiased and positive in nature.\n\nIf a question does not make any sense, "
    "or is not factually coherent, explain why instead of answering something not correct. If "
    "you don't know the answer to a question, please don't share false information."
)
