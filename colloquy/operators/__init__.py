"""DataFrame operators over messages, sessions, topics, quizzes and stores."""
