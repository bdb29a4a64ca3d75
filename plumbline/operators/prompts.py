"""Texts for models: evaluation prompts, tool catalogues, and the messages of a tool-calling dialogue, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The marks of an audio and of a chat's parts.
AUDIO_TOKEN = "<|audio_bos|><|AUDIO|><|audio_eos|>"
SYSTEM, USER, ASSISTANT, END = "<|im_start|>system\n", "<|im_start|>user\n", "<|im_start|>assistant\n", "<|im_end|>\n"
#: What evaluation prompts say.
FOCUS = "Focus on the audio clip and answer the question."
ANSWER_WITH = "Please answer with the best choice letter and the full choice text.\n"
CONSIDER = "Considering the audio, is the proposed answer correct? Respond with exactly one word: True or False.\n"
EXPERT = "You are an expert in audio analysis and question answering."
NO_TOOLS_YET = "No tools have been invoked yet."
MULTIPLE_CHOICE_SYSTEM = """
{system_prompt}

You are given a question about an audio clip along with multiple-choice options.

{tools_description}

{workflow}
"""
WORKFLOW = """
## Workflow
You have access to a set of tools that can extract information from the audio.
You operate in a multi-turn loop. At each turn, you receive the original question and the results of any tools invoked so far. You then choose one of two actions:

**Action A — Invoke tool(s)**
If the current information is insufficient to answer confidently, request one or more tools.
Output a JSON list:

[
  {{
    "tool": "ToolName",
    "role": "required" | "helpful",
    "importance_score": <integer 1–10>,
    "reason": "Explain why this tool is needed given what you already know, and how its output helps answer the question.",
    "parameters": {{"example_param": "value"}}
  }}
]

**Action B — Answer**
If you have enough information to answer confidently, output:

{{
  "answer": "<option>",
  "reason": "<explanation based on tool results and/or prior knowledge>"
}}
"""
FINAL_ROUND = """
### Your Task
Based on all previously collected information, answer the question.
"""
USER_TURN = """
"Focus on the audio clips and answer the question."
## Question
{question}

## Audio
{audio}

## Options
{options}

## Tool Results So Far
Before the current turn, you have invoked some tools and received their results. Here is a summary of the information you have so far:
{tool_results}
"""
AUDIO_ELEMENT = """
audio id: {audio_id}
audio: {audio_token}
"""
#: The agent's protocol, before its catalogue of tools.
PROTOCOL = (
    "You are an audio-editing assistant with access to a fixed set of tools. "
    "You are given one or more input audios (tagged <audio_0>, <audio_1>, ...) and a "
    "task instruction. Infer the chain of tool calls needed to complete the task.\n\n"
    "Respond with exactly one JSON object per turn and nothing else:\n"
    '  {"tool_name": "<tool name>", "parameters": {"audio_id": "<id of the audio to read>", '
    '<other tool arguments>}, "output_audio_id": "<a new id for this call\'s output>"}\n\n'
    "`audio_id` must refer to an audio you have already seen -- one of the input audios or "
    "an `output_audio_id` you declared in an earlier turn. If omitted, it defaults to "
    "whichever audio your previous turn most recently produced (or the sole input audio, "
    "on your first turn). After each tool call you will be shown its real result -- a new "
    "audio -- tagged with the id you gave it, before your next turn. Always give each call "
    "a fresh output id, distinct from every id used so far. Once the task is fully "
    'complete, respond with {"done": true} instead of another tool call.\n\n'
)
TOOLS_BEGIN = "Available tools:\n"
#: What each tool does.
_SEGMENT_NEEDS = "Requires audio_path and HH:MM:SS.mmm timestamps for audio_begin and audio_end."
_LABELS = 'The label must be one of the fixed supported values: "vocals", "background sound", "background music", "noise". '
DESCRIPTIONS = {
    "asr": "Transcribe speech from a WAV audio segment into text. Requires audio_path plus HH:MM:SS.mmm timestamps for audio_begin and audio_end, with optional language selection.",
    "clipping": "Extract a WAV audio segment from a source file between specified HH:MM:SS.mmm begin and end timestamps.",
    "denoise": "Apply noise reduction or echo cancellation to a WAV audio file using the chosen algorithm. Requires audio_path and algorithm; optional noise_factor and sensitivity control processing.",
    "amplitude_normalize": f"Normalize the amplitude of a WAV audio segment to a consistent peak or RMS level. {_SEGMENT_NEEDS}",
    "loudness_normalize": f"Normalize a WAV audio segment to a target loudness level in LUFS. {_SEGMENT_NEEDS}",
    "remove_dc_offset": f"Remove DC bias from a WAV audio segment. {_SEGMENT_NEEDS}",
    "spectral_normalize": f"Adjust the spectral energy distribution of a WAV audio segment to make frequency band energy more balanced. {_SEGMENT_NEEDS}",
    "trim_silence": f"Trim silence from the beginning and end of a WAV audio segment. {_SEGMENT_NEEDS}",
    "pre_emphasis": f"Apply a pre-emphasis filter to a WAV audio segment to boost high-frequency content and improve spectral balance. {_SEGMENT_NEEDS}",
    "source_separation": 'Separate a WAV audio segment into a target component and residual.Accepts open-ended natural language target_description (e.g., "human voice", "background music", "bird chirping", "traffic noise") to define the target sound.',
    "extract_target": f"Extract a specific sound source from a WAV audio segment. {_LABELS}Saves only the extracted target channel.",
    "remove_target": f"Remove a specific sound source from a WAV audio segment. {_LABELS}Saves the residual audio with that source removed.",
    "human_voice_enhance": "Enhance human voice in an audio file by reducing background noise using DeepFilterNet. Supports WAV, MP3, FLAC, OGG, AIFF, and other formats readable by soundfile or librosa.",
    "super_resolution": "Upsample and restore high-frequency detail of an audio file using the AudioSR latent diffusion model, producing a 48kHz output. Useful for improving low-quality, band-limited, or low-sample-rate recordings.",
    "pitch_shift": "Shift the pitch of an audio file (WAV or MP3) by a number of semitones without changing its duration, using librosa. Requires audio_path and n_steps (semitones; positive shifts up, negative shifts down).",
    "time_stretch": "Time-stretch an audio file (WAV or MP3) by a fixed rate without changing its pitch, using librosa. Requires audio_path and rate (rate > 1 speeds up/shortens, rate < 1 slows down/lengthens).",
}
#: What some parameters mean.
PARAMETER_NOTES = {
    ("extract_target", "target_description"): "The sound source to extract.",
    ("remove_target", "target_description"): "The sound source to remove.",
    ("super_resolution", "model_name"): "AudioSR checkpoint to use. 'speech' is tuned for speech audio.",
    ("super_resolution", "ddim_steps"): "Number of DDIM sampling steps. Higher is slower but may improve quality.",
    ("super_resolution", "guidance_scale"): "Classifier-free guidance scale.",
    ("pitch_shift", "n_steps"): "Number of semitones to shift. Positive values shift up, negative values shift down.",
    ("pitch_shift", "bins_per_octave"): "Number of steps per octave (default 12).",
    ("time_stretch", "rate"): "Stretch factor. Values > 1 speed up (shorten); values < 1 slow down (lengthen).",
}


def fill(template: str, **values: Column | str) -> Column:
    """The template with {name} for values and doubled braces for single ones, as str.format reads it; values are not read again."""
    import string

    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        parts += [F.lit(text)] if text else []
        parts += [values[name] if isinstance(values[name], Column) else F.lit(values[name])] if name else []
    return F.concat(*parts)


def lines(choices: Column) -> Column:
    """Choices one below another; none give an empty text."""
    return F.coalesce(F.array_join(choices, "\n"), F.lit(""))


def standard_prompt(question: Column, choices: Column, system: Column) -> Column:
    """A question on one audio, without tool results."""
    return F.concat(F.lit(SYSTEM), system, F.lit(END + USER + FOCUS + AUDIO_TOKEN + "\nQuestion: "), question, F.lit("\nChoose from the following options:\n"), lines(choices), F.lit("\n" + ANSWER_WITH + END + ASSISTANT))


def user_turn(question: Column, options: Column, audio: Column | str, tool_results: Column) -> Column:
    """A round's user message; without results it says so."""
    return fill(USER_TURN, question=question, options=options, audio=audio, tool_results=F.coalesce(tool_results, F.lit(NO_TOOLS_YET)))


def system_turn(tools_description: Column, final: bool = False) -> Column:
    """A round's system message; the last round only asks for the answer."""
    if final:
        return F.lit(FINAL_ROUND)
    return fill(MULTIPLE_CHOICE_SYSTEM, system_prompt=EXPERT, tools_description=tools_description, workflow=WORKFLOW)


def tool_chain_prompt(question: Column, choices: Column, system: Column, tool_results: Column) -> Column:
    """A question on an audio and the results of the tools that were run on it."""
    return F.concat(F.lit(SYSTEM), system, F.lit(END + USER), user_turn(question, lines(choices), AUDIO_TOKEN, tool_results), F.lit(ANSWER_WITH + END + ASSISTANT))


def verification_prompt(question: Column, choices: Column, system: Column, answer: Column, n_audios: Column) -> Column:
    """Asks for True or False on a proposed answer; an item without audio still has one token."""
    return F.concat(
        F.lit(SYSTEM), system, F.lit(END + USER), F.repeat(F.lit(AUDIO_TOKEN), F.greatest(n_audios, F.lit(1))), F.lit("\nQuestion: "), question, F.lit("\nChoices:\n"), lines(choices),
        F.lit("\nProposed answer: "), answer, F.lit("\n" + CONSIDER + END + ASSISTANT),
    )


def audio_element(audio_id: Column, audio_token: str = AUDIO_TOKEN) -> Column:
    return fill(AUDIO_ELEMENT, audio_id=audio_id, audio_token=audio_token)


def catalogue(schema: DataFrame) -> DataFrame:
    """(tool, text) from rows (tool, param, type, allowed, required): what the tool does, and its parameters by name."""
    spark: SparkSession = schema.sparkSession
    notes = spark.createDataFrame([(*k, note) for k, note in PARAMETER_NOTES.items()], "tool string, param string, note string")
    about = spark.createDataFrame(list(DESCRIPTIONS.items()), "tool string, about string")
    timed = F.col("type") == "timestamp"
    allowed = F.concat(F.lit(", allowed=['"), F.array_join("allowed", "', '"), F.lit("']"))
    line = F.concat(
        F.lit("- "), "param", F.lit(" ("), F.when(timed, "string").otherwise(F.col("type")), F.lit("), "), F.when(F.col("required"), "required").otherwise("optional"),
        F.when(timed, ", format=HH:MM:SS.mmm").otherwise(""), F.coalesce(allowed, F.lit("")), F.coalesce(F.concat(F.lit(", "), "note"), F.lit("")),
    )
    told = schema.join(F.broadcast(notes), ["tool", "param"], "left").groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("param", line.alias("line")))).alias("x"))
    return told.join(F.broadcast(about), "tool").select("tool", F.concat("tool", F.lit(": "), "about", F.lit("\nParameters:\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n")).alias("text"))


def composed_system(tools_block: Column, base: Column) -> Column:
    return F.concat(base, F.lit("\n\n" + TOOLS_BEGIN), tools_block)


def resolved_system(tools_block: Column, override: Column, official: Column, tuned: Column) -> Column:
    """The system prompt that an entry was trained with: an override, else the official base of a tuned model, else the protocol;
    with the tools after it where the entry has them (not empty). A tuned model's old entry, without tools, has none."""
    has_tools = F.coalesce(tools_block != "", F.lit(False))
    base = F.coalesce(override, F.when(tuned, official).otherwise(F.lit(PROTOCOL)))
    return F.when(has_tools, composed_system(tools_block, base)).otherwise(F.coalesce(override, F.when(~tuned, F.lit(PROTOCOL))))


def quoted(text: Column) -> Column:
    """A JSON string; Unicode stays as it is."""
    listed = F.to_json(F.array(text))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def call_message(tool: Column, parameters_json: Column, output_id: Column) -> Column:
    """An assistant's turn that calls a tool. parameters_json: a JSON object as text."""
    return F.concat(F.lit('{"tool_name": '), quoted(tool), F.lit(', "parameters": '), parameters_json, F.lit(', "output_audio_id": '), quoted(output_id), F.lit("}"))


#: Fixed value: an assistant's last turn.
DONE_MESSAGE = '{"done": true}'


def result_message(step: Column, tool: Column, tags: Column, text: Column) -> Column:
    """The tool's turn after a call: its audios' tags, or its text if there are none."""
    begin = F.concat(F.lit("Output of step "), step.cast("string"))
    return F.when(F.size(tags) > 0, F.concat(begin, F.lit(": "), F.array_join(tags, " "))).otherwise(F.concat(begin, F.lit(" ("), tool, F.lit("): "), F.coalesce(text, F.lit("None"))))


def audio_tag(audio_id: Column, token: str = AUDIO_TOKEN) -> Column:
    return F.concat(F.lit("<"), audio_id, F.lit(">" + token))


def user_message(instruction: Column, audio_ids: Column, token: str = AUDIO_TOKEN) -> Column:
    tagged = F.transform(audio_ids, lambda x: F.concat(x, F.lit(": "), audio_tag(x, token)))
    return F.concat(instruction, F.lit("\n\nInput audio:\n"), F.array_join(tagged, "\n"))


def audio_outputs(separated: Column, output_path: Column, clip_path: Column) -> Column:
    """The new audios of a tool's result by name: its separated files if it has any, else its output, else its clip, under the
    empty name; an empty map if there is none."""
    alone = F.coalesce(F.nullif(output_path, F.lit("")), F.nullif(clip_path, F.lit("")))
    return F.when(F.coalesce(F.size(separated) > 0, F.lit(False)), separated).when(alone.isNotNull(), F.create_map(F.lit(""), alone)).otherwise(F.create_map().cast("map<string,string>"))
