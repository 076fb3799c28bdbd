"""phonolake: PySpark-native analytics for speech transcripts and conversational audio."""
