"""Web-content and corpus analytics as set-at-a-time DataFrame pipelines."""
