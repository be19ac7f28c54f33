"""Prompt and message formats."""

# --------------------------------------------------------------------------
# Rendered prompts must equal these texts, blanks included.
# {name} marks a column.
# --------------------------------------------------------------------------

REPORT_SECTION = "- Radiology Report: {report}"
REPORT_SECTION_EMPTY = "- Radiology Report: Not available."

ZERO_SHOT = """
    You are an expert otolaryngologist evaluating an ENT case.
    Based ONLY on the information provided below, make a recommendation on surgery.

    --- Case Details ---
    - Case ID: {case_id}
    - Clinical Summary from ENT Notes: {note}
    {report_section}

    ---

    Provide your response as a JSON object with three keys:
    1. "decision": Your recommendation, either "Yes" or "No".
    2. "confidence": Your confidence level from 1 (not confident) to 10 (very confident).
    3. "reasoning": A brief, 2-4 sentence explanation for your decision.

    Return ONLY the JSON object, no additional text.
    """

SCALED = (
    """
    === OBJECTIVE ===
    You are an expert otolaryngologist evaluating an ENT case. \n"""
    """    Decide **only** whether surgery is recommended based on the information provided.

    === INSTRUCTIONS ===
    1. Rely strictly on the case details below (do not invent information).  \n"""
    """    2. Respond with a single **valid JSON object** — no extra text, headings, or explanations outside the JSON.  \n"""
    """    3. Follow the schema exactly. \n"""
    """    4. For CONFIDENCE, choose **one integer value (1–10)** from the Confidence Scale. Do not output ranges or text.

    === CONFIDENCE SCALE (1–10) ===
    1 = no confidence (likely wrong)  \n"""
    """    3–4 = low (uncertain, weak support)  \n"""
    """    5 = moderate (plausible but partly speculative)  \n"""
    """    6–7 = fairly confident (reasonable but some gaps/hedging)  \n"""
    """    8 = high (well supported, minor uncertainty)  \n"""
    """    9 = very high (strong reasoning, unlikely error)  \n"""
    """    10 = certain (clear, fully supported, no doubt)

    === CASE DETAILS ===
    - Case ID: {case_id}
    - Clinical Summary: {note}
    {report_section}

    === OUTPUT SCHEMA ===
    Respond **only** using the JSON structure below. Do not repeat or paraphrase the instructions, and do not include introductory
    or closing comments. Your output must begin and end with a single valid JSON object:

    {
    "DECISION": "Yes" | "No",            // Whether surgery is recommended
    "CONFIDENCE": 1–10,                  // 1 = no confidence, 10 = certain
    "REASONING": "2–4 sentences explaining the decision"
    }
    """
)

EXAMPLE = """
        --- Example Case Details ---
        - Example Case ID: {case_id}:
        - Clinical Summary from ENT Notes: {note}
        {report_section}
        - Patient had surgery: {outcome}
""" + "        \n        "

FEW_SHOT = """
    You are an expert otolaryngologist evaluating an ENT case.
    Here are a few examples of cases and whether the patient had surgery:

    {examples}

    Based ONLY on these examples and the information provided below, make a recommendation on surgery.

    --- Case Details ---
    - Case ID: {case_id}
    - Clinical Summary from ENT Notes: {note}
    {report_section}

    ---

    Provide your response as a JSON object with three keys:
    1. "decision": Your recommendation, either "Yes" or "No".
    2. "confidence": Your confidence level from 1 (not confident) to 10 (very confident).
    3. "reasoning": A brief, 2-4 sentence explanation for your decision.

    Return ONLY the JSON object, no additional text."""

CHAT_SYSTEM = (
    "You are an expert otolaryngologist. I will first provide you with training examples "
    "of ENT cases and their surgical outcomes. After reviewing all examples, you will "
    "evaluate new cases and provide surgical recommendations in JSON format."
)

CHAT_REPORT = "\nRadiology: {report}"
CHAT_REPORT_EMPTY = "\nRadiology: Not available"

CHAT_INTRO = "Here are training examples of ENT cases and their surgical outcomes:\n\n"

CHAT_EXAMPLE = """TRAINING CASE {case_id}:
            Clinical Notes: {note}{chat_report}
            Surgical Outcome: {outcome}

            ---

            """

CHAT_INSTRUCTIONS = """
            Please confirm you have reviewed these training examples. I will then ask you to evaluate new cases.
            For each new case, provide your response as JSON with:
            1. "decision": Your recommendation, either "Yes" or "No".
            2. "confidence": Your confidence level from 1 (not confident) to 10 (very confident).
            3. "reasoning": A brief, 2-4 sentence explanation for your decision.

            """

CHAT_REPORT_SECTION_EMPTY = "- Radiology Report: Not available"

CHAT_CASE = """
        Based on training data and the information provided below, make a recommendation on surgery.

        --- Case Details ---
        - Case ID: {case_id}
        - Clinical Summary from ENT Notes: {note}
        {report_section}

        ---

        Provide your response as a JSON object with three keys:
        1. "decision": Your recommendation, either "Yes" or "No".
        2. "confidence": Your confidence level from 1 (not confident) to 10 (very confident).
        3. "reasoning": A brief, 2-4 sentence explanation for your decision.

        Return ONLY the JSON object, no additional text."""

PROFILE = (
    """
    You are an expert otolaryngologist evaluating a case of chronic sinusitis.
    Based ONLY on the information provided below, make a recommendation on sinus surgery.

    --- Case Details ---
    - Case Index: {case_id}
    - Age: {age}
    - Sex: {sex}
    - Censored Clinical Summary from ENT Notes: {note}
    {report_section}
    t
    ---
    \n"""
    """    Provide your response as a JSON object with three keys:
    1. "decision": Your recommendation, either "Yes" or "No".
    2. "confidence": Your confidence level from 1 (not confident) to 10 (very confident).
    3. "reasoning": A brief, 2-4 sentence explanation for your decision.
    """
)

# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------
