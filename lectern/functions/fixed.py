"""Header maps, required columns, skill lists and report texts.

Results depend on these exact values, so they are stated as plain data.
"""

# Export header -> internal header, per kind of export.
EXPORT_HEADERS = {
    "course": {
        "Name": "Name",
        "Email": "Email",
        "External Id": "External ID",
        "External ID": "External ID",
        "Course": "Course Name",
        "Course Name": "Course Name",
        "Course Id": "Course Id",
        "course_id": "Course Id",
        "Course Slug": "Course Slug",
        "University": "Institution",
        "Institution": "Institution",
        "Enrollment Time": "Enrollment Timestamp",
        "Enrollment Timestamp": "Enrollment Timestamp",
        "Completion Time": "Completion Timestamp",
        "Completion Timestamp": "Completion Timestamp",
        "Last Course Activity Time": "Last Activity Timestamp",
        "Last Activity Timestamp": "Last Activity Timestamp",
        "Overall Progress": "Progress (%)",
        "Progress (%)": "Progress (%)",
        "Course Grade": "Grade (%)",
        "Grade (%)": "Grade (%)",
        "Learning Hours": "Learning Hours",
        "Estimated Learning Hours": "Estimated Learning Hours",
        "Completed": "Completed",
        "Course Type": "Course Type",
        "Business Unit": "Business Unit",
        "Business Unit 2": "Business Unit 2",
        "Job Title": "Role",
        "Role": "Role",
        "Location City": "Location",
        "Location": "Location",
        "Location Region": "Location Region",
        "Location Country": "Location Country",
        "Program Name": "Program Name",
        "Program Slug": "Program Slug",
        "Manager Name": "Manager Name",
        "Manager Email": "Manager Email",
        "Removed From Program": "Removed From Program",
    },
    "specialization": {
        "Name": "Name",
        "Email": "Email",
        "External Id": "External ID",
        "External ID": "External ID",
        "Specialization": "Specialization Name",
        "Specialization Name": "Specialization Name",
        "Specialization Id": "Specialization Id",
        "Specialization Slug": "Specialization Slug",
        "University": "Institution",
        "Enrollment Time": "Enrollment Timestamp",
        "Enrollment Timestamp": "Enrollment Timestamp",
        "Last Specialization Activity Time": "Last Activity Timestamp",
        "Last Activity Timestamp": "Last Activity Timestamp",
        "Specialization Completion Time": "Completion Timestamp",
        "# Completed Courses": "Courses Completed",
        "Courses Completed": "Courses Completed",
        "# Courses in Specialization": "Total Courses",
        "Total Courses": "Total Courses",
        "Completed": "Completed",
        "Learning Hours": "Learning Hours",
        "Program Name": "Program Name",
        "Program Slug": "Program Slug",
        "Business Unit": "Business Unit",
        "Job Title": "Role",
        "Location City": "Location",
        "Location Region": "Location Region",
        "Location Country": "Location Country",
        "Removed From Program": "Removed From Program",
    },
    "video": {
        "Name": "Name",
        "Email": "Email",
        "External Id": "External ID",
        "External ID": "External ID",
        "Course": "Course Name",
        "Course Name": "Course Name",
        "Course Id": "Course Id",
        "Course Slug": "Course Slug",
        "Clip Name": "Video Id",
        "Video Id": "Video Id",
        "Clip Title": "Video Name",
        "Video Name": "Video Name",
        "Clip Url": "Video URL",
        "First Video Clip Activity Time": "First Watch Timestamp",
        "Last Video Clip Activity Time": "Last Watch Timestamp",
        "Last Watch Timestamp": "Last Watch Timestamp",
        "Progress Percentage": "Completion (%)",
        "Completion (%)": "Completion (%)",
        "# of Times Watched": "Watch Count",
        "Watch Count": "Watch Count",
        "Completed at least 90% of clip": "Video Completed",
        "Learning Hours": "Learning Hours",
        "Estimated Learning Hours": "Estimated Learning Hours",
        "Led to Course Enrollment": "Led to Enrollment",
        "Program Name": "Program Name",
        "Business Unit": "Business Unit",
        "Job Title": "Role",
        "Location City": "Location",
        "Removed From Program": "Removed From Program",
    },
    "program": {
        "Name": "Name",
        "Email": "Email",
        "External Id": "External ID",
        "External ID": "External ID",
        "Program Id": "Program Id",
        "Program Name": "Program Name",
        "Program Slug": "Program Slug",
        "Total Courses in Program": "Total Courses",
        "Courses Completed": "Courses Completed",
        "Progress (%)": "Progress (%)",
        "Learning Hours": "Learning Hours",
        "Completed": "Completed",
        "Enrollment Timestamp": "Enrollment Timestamp",
        "Last Activity Timestamp": "Last Activity Timestamp",
        "Business Unit": "Business Unit",
        "Job Title": "Role",
        "Location City": "Location",
    },
}

# Columns an export must have after renaming.
EXPORT_REQUIRED = {
    "course": ["Email", "Course Name"],
    "specialization": ["Email", "Specialization Name"],
    "video": ["Email", "Course Name"],
    "program": ["Email", "Program Name"],
}

# Words in a file name that tell the kind of export, in order of priority.
EXPORT_FILE_WORDS = {
    "video": ["video", "clip"],
    "specialization": ["speciali"],
    "program": ["program"],
    "course": ["course"],
}

# Required columns of the student sources, and each source's column in the id map.
STUDENT_REQUIRED = {
    "coursera": ["student_id", "course_id", "timestamp", "activity_type"],
    "lms": ["student_id", "course_id", "session_start", "session_end"],
    "academic": ["student_id", "course_id", "grade", "semester"],
}
STUDENT_ID_COLUMNS = {"coursera": "coursera_id", "lms": "lms_id", "academic": "academic_id"}
SOURCE_PRIORITY = ["academic", "lms", "coursera"]

# Skill categories.
SKILL_CATEGORIES = {
    "Data Science": ["Machine Learning", "Statistics", "Data Visualization", "Data Analysis", "R Programming"],
    "Programming": ["Python", "Programming Fundamentals", "SQL", "Databases"],
    "AI & Deep Learning": ["Deep Learning", "Neural Networks", "TensorFlow", "NLP"],
    "Cloud & Infrastructure": [
        "AWS", "Cloud Computing", "Infrastructure", "Cybersecurity", "Network Security", "Risk Assessment",
    ],
    "Business": [
        "Project Management", "Agile", "Leadership", "Strategy", "Business Analysis", "Excel",
        "Business Intelligence",
    ],
    "Marketing & Design": ["Digital Marketing", "SEO", "Analytics", "UX Design", "Prototyping", "User Research"],
    "Finance": ["Finance", "Risk Management", "Investment"],
    "Data Analytics": ["Data Analytics", "Spreadsheets", "Tableau"],
    "Mathematics & Science": [
        "Mathematics", "Engineering", "Science", "Physics", "Chemistry", "Biology", "Biotechnology", "Economics",
    ],
    "Emerging Tech": ["Blockchain", "IoT", "Robotics", "Automation", "Prompt Engineering"],
    "Web & Software": ["Web Development", "JavaScript", "Java", "C++"],
    "Management": ["Management", "Communication", "Negotiation"],
}

# Skills of the catalogue courses.
COURSE_SKILLS = {
    "CRS-001": ["Machine Learning", "Python", "Statistics"],
    "CRS-002": ["Deep Learning", "Neural Networks", "TensorFlow"],
    "CRS-003": ["Python", "Programming Fundamentals"],
    "CRS-004": ["R Programming", "Statistics", "Data Visualization"],
    "CRS-005": ["SQL", "Data Analytics", "Spreadsheets", "Tableau"],
    "CRS-006": ["AWS", "Cloud Computing", "Infrastructure"],
    "CRS-007": ["Digital Marketing", "SEO", "Analytics"],
    "CRS-008": ["Project Management", "Agile", "Leadership"],
    "CRS-009": ["Finance", "Risk Management", "Investment"],
    "CRS-010": ["UX Design", "Prototyping", "User Research"],
    "CRS-011": ["Cybersecurity", "Network Security", "Risk Assessment"],
    "CRS-012": ["Strategy", "Business Analysis", "Leadership"],
    "CRS-013": ["SQL", "Databases", "Data Analysis"],
    "CRS-014": ["NLP", "Deep Learning", "Python"],
    "CRS-015": ["Excel", "Data Analysis", "Business Intelligence"],
}

# Skills told by a word in the course name.
KEYWORD_SKILLS = {
    "python": ["Python", "Programming Fundamentals"],
    "java": ["Java", "Programming Fundamentals"],
    "javascript": ["JavaScript", "Programming Fundamentals"],
    "c++": ["C++", "Programming Fundamentals"],
    "machine learning": ["Machine Learning", "Statistics", "Python"],
    "deep learning": ["Deep Learning", "Neural Networks"],
    "artificial intelligence": ["Machine Learning", "Deep Learning"],
    "ai ": ["Machine Learning", "Deep Learning"],
    "neural network": ["Neural Networks", "Deep Learning"],
    "nlp": ["NLP", "Deep Learning"],
    "natural language": ["NLP", "Deep Learning"],
    "data science": ["Data Science", "Statistics", "Python"],
    "data analysis": ["Data Analysis", "Statistics"],
    "data analytics": ["Data Analytics", "Data Analysis"],
    "statistics": ["Statistics", "Data Analysis"],
    "sql": ["SQL", "Databases"],
    "database": ["SQL", "Databases"],
    "excel": ["Excel", "Data Analysis"],
    "tableau": ["Tableau", "Data Visualization"],
    "power bi": ["Power BI", "Data Visualization"],
    "visualization": ["Data Visualization"],
    "r programming": ["R Programming", "Statistics"],
    "tensorflow": ["TensorFlow", "Deep Learning"],
    "pytorch": ["Deep Learning", "Python"],
    "cloud": ["Cloud Computing", "Infrastructure"],
    "aws": ["AWS", "Cloud Computing"],
    "azure": ["Cloud Computing", "Infrastructure"],
    "gcp": ["Cloud Computing", "Infrastructure"],
    "devops": ["DevOps", "Cloud Computing"],
    "docker": ["DevOps", "Infrastructure"],
    "kubernetes": ["DevOps", "Cloud Computing"],
    "cybersecurity": ["Cybersecurity", "Network Security"],
    "security": ["Cybersecurity", "Risk Assessment"],
    "blockchain": ["Blockchain", "Programming Fundamentals"],
    "web development": ["Web Development", "Programming Fundamentals"],
    "react": ["Web Development", "JavaScript"],
    "html": ["Web Development", "Programming Fundamentals"],
    "css": ["Web Development", "Programming Fundamentals"],
    "project management": ["Project Management", "Leadership"],
    "agile": ["Agile", "Project Management"],
    "scrum": ["Agile", "Project Management"],
    "leadership": ["Leadership", "Management"],
    "management": ["Management", "Leadership"],
    "business": ["Business Analysis", "Strategy"],
    "strategy": ["Strategy", "Business Analysis"],
    "marketing": ["Digital Marketing", "Analytics"],
    "seo": ["SEO", "Digital Marketing"],
    "ux": ["UX Design", "User Research"],
    "ui": ["UX Design", "Prototyping"],
    "design": ["UX Design", "Prototyping"],
    "finance": ["Finance", "Business Analysis"],
    "accounting": ["Finance", "Business Analysis"],
    "economics": ["Economics", "Finance"],
    "communication": ["Communication", "Leadership"],
    "negotiation": ["Negotiation", "Leadership"],
    "differential equation": ["Mathematics", "Engineering"],
    "calculus": ["Mathematics", "Engineering"],
    "linear algebra": ["Mathematics", "Data Science"],
    "probability": ["Statistics", "Mathematics"],
    "engineering": ["Engineering"],
    "biotechnology": ["Biotechnology", "Science"],
    "biology": ["Biology", "Science"],
    "chemistry": ["Chemistry", "Science"],
    "physics": ["Physics", "Science"],
    "prompt engineering": ["Prompt Engineering", "Machine Learning"],
    "generative ai": ["Machine Learning", "Deep Learning"],
    "chatgpt": ["Machine Learning", "Prompt Engineering"],
    "automation": ["Automation", "Programming Fundamentals"],
    "robotics": ["Robotics", "Engineering"],
    "iot": ["IoT", "Engineering"],
    "networking": ["Network Security", "Infrastructure"],
    "ethical hacking": ["Cybersecurity", "Network Security"],
}
DEFAULT_SKILL = "General Knowledge"

# Weights of the two engagement scores.
ENGAGEMENT_WEIGHTS = {
    "progress_pct": 0.25,
    "learning_hours": 0.25,
    "video_interactions": 0.25,
    "recency_score": 0.25,
}
STUDENT_ENGAGEMENT_WEIGHTS = {
    "session_frequency": 0.3,
    "video_completion": 0.25,
    "assessment_score": 0.25,
    "forum_activity": 0.2,
}

# Columns that encode the outcome and must not serve as model inputs.
OUTCOME_COLUMNS = {
    "avg_progress", "max_progress", "courses_completed", "completion_rate", "avg_grade",
    "engagement_score", "progress_component",
}

# Texts of the insights; %s takes formatted numbers or names.
INSIGHT_TEXTS = {
    "completion_low": (
        "Low overall completion rate: %s%%",
        "Only %s%% of enrollments result in completion. "
        "Consider reviewing course difficulty, engagement strategies, or time allocation.",
    ),
    "completion_below": (
        "Below-average completion rate: %s%%",
        "Completion rate of %s%% is below the 50%% benchmark.",
    ),
    "course_worst": (
        "Course '%s' has only %s%% completion",
        "This course may need content review, better prerequisites, or pacing adjustments.",
    ),
    "course_best": (
        "Top performing course: '%s' at %s%% completion",
        "Study this course's structure as a best-practice template.",
    ),
    "engagement_ratio": (
        "High engagement learners are %sx more likely to complete",
        "High engagement completion: %s%% vs Low/At-Risk: %s%%. "
        "Investing in engagement interventions could improve outcomes.",
    ),
    "at_risk": (
        "%s learners (%s%%) are At-Risk",
        "These learners show low progress, minimal hours, and infrequent activity. "
        "Consider targeted outreach or nudge campaigns.",
    ),
    "drop_off": (
        "Highest drop-off zone: %s progress (%s%% of non-completers)",
        "%s learners stalled in the %s range. Examine course content at this stage for friction points.",
    ),
    "business_unit": (
        "'%s' has %s%% lower completion than average",
        "Completion rate: %s%% vs org avg %s%%. Avg learning hours: %sh. May indicate time/resource constraints.",
    ),
    "video_low": (
        "Average video completion is only %s%%",
        "Learners are watching less than half of video content on average. "
        "Consider shorter videos or more interactive content.",
    ),
    "video_rewatched": (
        "Most rewatched video: '%s'",
        "High rewatch rates may indicate complex material needing better explanation, "
        "or highly valued content worth referencing.",
    ),
    "program_low": (
        "Program completion rate is very low: %s%%",
        "Most learners are not completing full programs. Consider program length, pacing, or flexibility.",
    ),
    "mean_hours": (
        "Average total learning hours per learner: %sh",
        "Benchmark against industry averages and organizational targets.",
    ),
}
