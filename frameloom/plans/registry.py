"""All queries of the clip engine and the SQL they are held against."""

from frameloom.plans import clips, files, frames, video, workers

QUERIES = frames.QUERIES | clips.QUERIES | files.QUERIES | workers.QUERIES | video.QUERIES
ORACLES = frames.ORACLES | clips.ORACLES | files.ORACLES | workers.ORACLES | video.ORACLES
