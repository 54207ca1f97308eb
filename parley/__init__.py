"""parley: analytics over timed, speaker-attributed conversation transcripts on Spark."""
