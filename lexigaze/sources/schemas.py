"""Column types of the input tables."""

from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

S, I, D = StringType(), IntegerType(), DoubleType()


def _schema(**columns) -> StructType:
    return StructType([StructField(n, t) for n, t in columns.items()])


FIXATIONS = _schema(
    RECORDING_SESSION_LABEL=S, CURRENT_FIX_INTEREST_AREA_LABEL=S, TRIAL_INDEX=I, RT=D,
    TRIAL_START_TIME=D, audiotarget=S, carrier=S, distractorimage=S, targetimage=S,
    distractorloc=S, targetloc=S, pair=S, targetside=S, trial=S, trialtype=S, practice=S,
    fix_start=D, fix_end=D)

MESSAGES = _schema(RECORDING_SESSION_LABEL=S, TRIAL_INDEX=I, CURRENT_MSG_TIME=D,
                   CURRENT_MSG_TEXT=S, RT=S)

RELIABILITY = _schema(file=S, ordinal=I, onset=I, offset=I, word=S, orig_utt_type=S,
                      orig_present=S, new_utt_type=S, new_present=S)

COSINES = _schema(type=S, word1=S, word2=S, cosine=D)

ANNOTATIONS = _schema(subj=S, month=S, SubjectNumber=S, audio_video=S, speaker=S,
                      utterance_type=S, object_present=S, basic_level=S)

QUESTIONNAIRES = _schema(subj=S, feeding_6mo=S)
