"""Part of quizloom; see README.md."""
